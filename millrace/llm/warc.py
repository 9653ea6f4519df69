"""WARC records and a Merkle fixity audit of replicas.

Pages become WARC resource records, laid out in files of FILE_SLOTS consecutive ids; a record's
slot in its file follows from its id. A leaf is the SHA-256 of a record with its slot and length;
FANOUT neighbouring nodes hash into their parent, each with its offset range in it, up to one
root a file. So a root commits to the place of every byte, while a lost record, which shifts
those behind it, changes its own ancestors only. An audit compares the roots of two replicas,
then only the children of nodes that differ, level by level, down to records. Everything is
grouped by file and node, whose sizes are bounded by FILE_SLOTS; of pages only digests move.

``store`` puts records together as the bytes of files, and ``stored`` takes the digests of offset
ranges from such bytes, so that replicas can be audited as they lie on disk.

Cases: null urls and pages count as empty; rows without an id have no place in a file and are
left out; rows that repeat an id share its slot, in the order of their bytes' digest; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

FANOUT = 8
FILE_SLOTS = 512
LEVELS = 3  # FANOUT ** LEVELS = FILE_SLOTS
_CRLF = "\r\n"


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record of one page."""
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: resource{_CRLF}WARC-Record-ID: <urn:page:"), page_id.cast("string"),
        F.lit(f">{_CRLF}WARC-Target-URI: "), url, F.lit(f"{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.octet_length(html).cast("string"), F.lit(_CRLF * 2),
    )
    return F.concat(head, html, F.lit(_CRLF * 2))


def layout(pages: DataFrame) -> DataFrame:
    """page_id, file, slot, offset, length, digest of every record."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    rec = record_bytes(F.col("page_id"), url, html)
    rows = pages.where("page_id IS NOT NULL").select(
        F.col("page_id").cast("long").alias("page_id"), F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("sha")
    )
    rows = rows.withColumn("file", F.floor(F.col("page_id") / FILE_SLOTS).cast("long")).withColumn("slot", F.pmod("page_id", F.lit(FILE_SLOTS)).cast("int"))
    place = Window.partitionBy("file").orderBy("slot", "sha").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(place), F.lit(0)).cast("long"))
    return rows.select("page_id", "file", "slot", "offset", "length", F.sha2(F.concat_ws(":", "slot", "length", "sha"), 256).alias("digest"))


def tree(records: DataFrame) -> list[DataFrame]:
    """file, node, hash, length of each level: records' slots first, the roots last."""
    own = F.array_join(F.transform(F.array_sort(F.collect_list("digest")), lambda x: x), "")
    level = records.groupBy("file", F.col("slot").alias("node")).agg(F.sha2(own, 256).alias("hash"), F.sum("length").alias("length"))
    zero = F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("at"))
    step = lambda a, x: F.struct(F.concat(a["s"], a["at"].cast("string"), F.lit(":"), x["length"].cast("string"), F.lit(":"), x["hash"], F.lit(",")).alias("s"), (a["at"] + x["length"]).alias("at"))
    ranges = F.aggregate(F.array_sort(F.collect_list(F.struct("node", "hash", "length"))), zero, step, lambda a: a["s"])  # at most FANOUT
    out = [level]
    for _ in range(LEVELS):
        level = level.groupBy("file", F.floor(F.col("node") / FANOUT).cast("int").alias("up")).agg(F.sha2(ranges, 256).alias("hash"), F.sum("length").alias("length")).withColumnRenamed("up", "node")
        out.append(level)
    return out


def differences(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """file, node, status (corrupt, missing, extra) of the slots that differ; only branches that differ are descended."""
    bad = None
    for depth, (a, b) in enumerate(zip(reversed(primary), reversed(replica))):
        if bad is not None:
            up = bad.select("file", F.col("node").alias("up"))
            narrow = lambda x: x.join(up, (x["file"] == up["file"]) & (F.floor(x["node"] / FANOUT) == up["up"]), "left_semi")
            a, b = narrow(a), narrow(b)
        a, b = a.select("file", "node", F.col("hash").alias("one")), b.select("file", "node", F.col("hash").alias("two"))
        bad = a.join(b, ["file", "node"], "full_outer").where(~F.col("one").eqNullSafe(F.col("two")))
    return bad.select("file", "node", F.when(F.col("two").isNull(), "missing").when(F.col("one").isNull(), "extra").otherwise("corrupt").alias("status"))


def store(pages: DataFrame) -> DataFrame:
    """file, bytes: the records of each file one after another, in the order of ``layout``."""
    rec = record_bytes(F.col("page_id"), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).cast("binary")
    rows = pages.where("page_id IS NOT NULL").select(F.floor(F.col("page_id") / FILE_SLOTS).cast("long").alias("file"), F.pmod("page_id", F.lit(FILE_SLOTS)).cast("int").alias("slot"), F.sha2(rec, 256).alias("sha"), rec.alias("rec"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("slot", "sha", "rec"))), lambda x: x["rec"])
    return rows.groupBy("file").agg(F.aggregate(own, F.lit(b""), lambda a, x: F.concat(a, x)).alias("bytes"))


def stored(index: DataFrame, files: DataFrame) -> DataFrame:
    """index (of ``layout``) with the digests that its offset ranges have in stored bytes; ranges beyond a file's end are left out.

    files: file, bytes. A file meets the ranges of at most FILE_SLOTS slots at once, so its bytes move once.
    """
    ranges = index.groupBy("file").agg(F.collect_list(F.struct("page_id", "slot", "offset", "length")).alias("r"))
    cut = F.transform("r", lambda x: F.struct(x["page_id"].alias("page_id"), x["slot"].alias("slot"), x["offset"].alias("offset"), x["length"].alias("length"), F.sha2(F.substring(F.col("bytes"), (x["offset"] + 1).cast("int"), x["length"].cast("int")), 256).alias("sha"), (x["offset"] + x["length"] <= F.octet_length("bytes")).alias("whole")))
    rows = ranges.join(files, "file").select("file", F.explode(cut).alias("x")).where("x.whole").select("file", "x.*")
    return rows.select("page_id", "file", "slot", "offset", "length", F.sha2(F.concat_ws(":", "slot", "length", "sha"), 256).alias("digest"))


def audit(pages: DataFrame, copy: DataFrame) -> DataFrame:
    """page_id, file, slot, offset, length, digest, root, status of every record of pages against a replica of them."""
    spark = pages.sparkSession
    records = common.written(layout(pages), spark)
    mine, theirs = ([common.written(x, spark) for x in tree(r)] for r in (records, common.written(layout(copy), spark)))
    bad = differences(mine, theirs)
    roots = mine[-1].select("file", F.col("hash").alias("root"))
    return records.join(roots, "file").join(bad.withColumnRenamed("node", "slot"), ["file", "slot"], "left").select(
        "page_id", "file", "slot", "offset", "length", "digest", "root", F.coalesce("status", F.lit("ok")).alias("status")
    )


def decayed(pages: DataFrame) -> DataFrame:
    """A replica as bit rot leaves it: every 97th record with a changed byte, every 1009th lost."""
    return pages.where("page_id % 1009 <> 5 OR page_id IS NULL").withColumn("html", F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def op2(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, decayed(pages))


_LAYOUT = """
    SELECT page_id, page_id // 512 AS file, CAST(page_id % 512 AS INTEGER) AS slot,
           CAST(coalesce(sum(length) OVER (PARTITION BY page_id // 512 ORDER BY page_id % 512, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
           length, sha256((page_id % 512) || ':' || length || ':' || sha) AS digest
    FROM (SELECT page_id, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS sha FROM (
        SELECT page_id, 'WARC/1.1' || n || 'WARC-Type: resource' || n || 'WARC-Record-ID: <urn:page:' || page_id || '>' || n || 'WARC-Target-URI: ' || url || n
            || 'Content-Type: text/html; charset=utf-8' || n || 'Content-Length: ' || strlen(html) || n || n || html || n || n AS rec
        FROM (SELECT page_id, coalesce(url, '') AS url, coalesce({html}, '') AS html, chr(13) || chr(10) AS n FROM pages WHERE page_id IS NOT NULL{where})))"""

ORACLE = f"""
    WITH a AS ({_LAYOUT.format(html="html", where="")}),
    b AS ({_LAYOUT.format(html="CASE WHEN page_id % 97 = 13 THEN '~' || substring(html, 2) ELSE html END", where=" AND page_id % 1009 <> 5")}),
    l0 AS (SELECT file, slot AS node, sha256(string_agg(digest, '' ORDER BY digest)) AS h, CAST(sum(length) AS BIGINT) AS len FROM a GROUP BY ALL),
    c0 AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY file, node // 8 ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM l0),
    l1 AS (SELECT file, node // 8 AS node, sha256(string_agg(z || ':' || len || ':' || h || ',', '' ORDER BY c0.node)) AS h, CAST(sum(len) AS BIGINT) AS len FROM c0 GROUP BY file, node // 8),
    c1 AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY file, node // 8 ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM l1),
    l2 AS (SELECT file, node // 8 AS node, sha256(string_agg(z || ':' || len || ':' || h || ',', '' ORDER BY c1.node)) AS h, CAST(sum(len) AS BIGINT) AS len FROM c1 GROUP BY file, node // 8),
    c2 AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY file, node // 8 ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM l2),
    l3 AS (SELECT file, node // 8 AS node, sha256(string_agg(z || ':' || len || ':' || h || ',', '' ORDER BY c2.node)) AS h, CAST(sum(len) AS BIGINT) AS len FROM c2 GROUP BY file, node // 8)
    SELECT a.page_id, a.file, a.slot, a."offset", a.length, a.digest, l3.h AS root,
           CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.digest <> b.digest THEN 'corrupt' ELSE 'ok' END AS status
    FROM a JOIN l3 ON a.file = l3.file LEFT JOIN b ON a.page_id = b.page_id"""
