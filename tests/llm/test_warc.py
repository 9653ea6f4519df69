from pyspark.sql import functions as F

from millrace.llm import warc


def test_audit_finds_what_differs(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>é{i}</p>", 1) for i in range(1200)] + [(None, "x", "y", 1), (7, None, None, 2)], "page_id long, url string, html string, file int")
    copy = pages.where("page_id <> 600").withColumn("html", __import__("pyspark.sql.functions").sql.functions.expr("CASE WHEN page_id = 3 THEN '!' ELSE html END"))
    rows = warc.audit(pages, copy).collect()
    assert len(rows) == 1201
    assert {(r.page_id, r.status) for r in rows if r.status != "ok"} == {(3, "corrupt"), (600, "missing")}
    ends = {}
    for r in sorted(rows, key=lambda r: (r.file, r.offset)):
        assert r.offset == ends.get(r.file, 0)
        ends[r.file] = r.offset + r.length
    extra = warc.differences(warc.tree(warc.layout(copy)), warc.tree(warc.layout(pages))).collect()
    assert {(r.file * 512 + r.node, r.status) for r in extra} == {(3, "corrupt"), (600, "extra")}
    assert warc.audit(pages.limit(0), copy).count() == 0


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_flipped_stored_bytes_are_found(spark):
    pages = pages_of(spark, [(i, f"u{i}", f"<p>é{i}</p>" * (1 + i % 3)) for i in range(700)])
    index = warc.layout(pages)
    files = warc.store(pages)
    assert warc.differences(warc.tree(index), warc.tree(warc.stored(index, files))).count() == 0
    place = {r.page_id: r for r in index.collect()}
    raw = {r.file: bytearray(r.bytes) for r in files.collect()}
    assert bytes(raw[0][:8]) == b"WARC/1.1" and len(raw[1]) == sum(r.length for r in place.values() if r.file == 1)
    for i in (5, 511, 512):
        r = place[i]
        raw[r.file][r.offset + r.length - 5] ^= 1
    end = place[699]
    raw[end.file] = raw[end.file][: end.offset + end.length - 1]
    copy = spark.createDataFrame([(f, bytes(b)) for f, b in raw.items()], "file long, bytes binary")
    got = warc.differences(warc.tree(index), warc.tree(warc.stored(index, copy))).collect()
    assert {(r.file * 512 + r.node, r.status) for r in got} == {(5, "corrupt"), (511, "corrupt"), (512, "corrupt"), (699, "missing")}


def test_roots_commit_to_offset_ranges(spark):
    """The same digests with lengths that shift a range give other inner nodes."""
    index = warc.layout(pages_of(spark, [(i, "u", "h") for i in range(20)]))
    shifted = index.withColumn("length", F.col("length") + (F.col("page_id") == 3).cast("long") - (F.col("page_id") == 4).cast("long"))
    one, two = ({(r.file, r.node): r.hash for r in warc.tree(x)[1].collect()} for x in (index, shifted))
    assert one[0, 0] != two[0, 0] and one[0, 1] == two[0, 1]


def test_repeated_ids_long_records_and_empty_replicas(spark):
    pages = pages_of(spark, [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (2, "", "x" * 1_000_000), (3, None, None)])
    assert {r.status for r in warc.audit(pages, pages).collect()} == {"ok"}
    one_less = pages_of(spark, [(1, "u", "a"), (1, "u", "b"), (2, "", "x" * 1_000_000), (3, None, None)])
    assert sorted((r.page_id, r.status) for r in warc.audit(pages, one_less).collect()) == [(1, "corrupt")] * 3 + [(2, "ok"), (3, "ok")]
    assert {r.status for r in warc.audit(pages, pages.limit(0)).collect()} == {"missing"}
    assert warc.audit(pages.limit(0), pages).count() == 0
