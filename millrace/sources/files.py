"""Reading raw records: file lists, encodings, JSON lines, Parquet, metric logs, manifests."""

from __future__ import annotations

import codecs
import fnmatch
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.operators.ordering import running
from millrace.sources import storage, wide

PROBE = 64 << 10


def input_files(root: str, patterns=("*.jsonl", "*.jsonl.gz", "*.parquet"), exclude=()) -> list[str]:
    """Files under root (or root itself) that match, without excluded ones, sorted; a missing root has none. Any Hadoop file system."""
    return [f.path for f in listed(root, patterns, exclude)]


def listed(root: str, patterns=("*.jsonl", "*.jsonl.gz", "*.parquet"), exclude=()) -> list[storage.File]:
    """``input_files`` with sizes and times."""
    found = storage.files_under(root)
    if len(found) == 1 and not storage.is_folder(root):
        return found
    base = lambda f: f.path.rpartition("/")[2]
    return [f for f in found if any(fnmatch.fnmatch(base(f), p) for p in patterns) and not any(fnmatch.fnmatch(f.path, x) or fnmatch.fnmatch(base(f), x) for x in exclude)]


def sample_files(root: str, exclude=()) -> list[str]:
    """The JSON-lines files that a sampler reads; none is an error."""
    found = input_files(root, ("*.jsonl",), exclude)
    if not found:
        raise ValueError(f"no JSON-lines files under {root}")
    return found


def resolve(path: str) -> list[str]:
    """Files of a YAML manifest, a file or a folder. Entries of a manifest are under files or datasets, as paths or {path: ...}: folders are searched, files taken as they are."""
    if not path.endswith((".yaml", ".yml")):
        return input_files(path, ("*.jsonl",))
    import yaml

    manifest = yaml.safe_load(storage.read_text(path)) or {}
    out = []
    for entry in manifest.get("files", manifest.get("datasets", [])):
        item = entry.get("path") if isinstance(entry, dict) else entry
        if item is not None:
            place = item if item.startswith("/") or "://" in item else f"{path.rpartition('/')[0]}/{item}"
            out += input_files(place, ("*.jsonl",)) if storage.is_folder(place) else [place]
    return out


def encoding_of(path: str) -> str:
    """utf-16 or utf-32 by their marks; else utf-8-sig, utf-8 or gb18030, whichever decodes the first bytes strictly; else utf-8."""
    head = storage.head(path, PROBE)
    if head is None:
        raise FileNotFoundError(path)
    for mark, name in ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if head.startswith(mark):
            return name
    for name in ("utf-8-sig", "utf-8", "gb18030"):
        if name == "utf-8-sig" and not head.startswith(codecs.BOM_UTF8):
            continue
        try:
            codecs.getincrementaldecoder(name)("strict").decode(head)
        except UnicodeDecodeError:
            continue
        return name
    return "utf-8"


def _decoded(batches):
    """Lines of GB18030 files; what can't be decoded becomes U+FFFD."""
    for b in batches:
        lines = [x.decode("gb18030", "replace") for x in b.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lines, pa.string())], names=b.schema.names)


def text_lines(spark: SparkSession, paths: list[str], encodings: dict[str, str] | None = None) -> DataFrame:
    """file, begin (of the split), id (ascending in a split), line: every line that isn't blank, stripped; byte order marks go.

    Files are cut by Spark where their encoding allows it: UTF-8 and GB18030 at the byte 0x0A, which is no part of any longer
    character in either, and UTF-16 and UTF-32 files as ``wide`` says.
    """
    by: dict[str, list] = {}
    for p in paths:
        name = (encodings or {}).get(p) or encoding_of(p)
        if name in ("utf-16", "utf-32"):
            by.setdefault("wide", []).append((p, name))
        else:
            by.setdefault("gb18030" if name == "gb18030" else "utf-8", []).append(p)
    frames = []
    for kind, own in by.items():
        if kind == "wide":
            df = wide.lines(spark, own)
        else:
            df = spark.read.text(own).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("id"), "value")
        if kind == "gb18030":
            df = df.withColumn("value", F.col("value").cast("binary")).mapInArrow(_decoded, "file string, begin long, id long, value string")
        frames.append(df)
    if not frames:
        return spark.createDataFrame([], "file string, begin long, id long, line string")
    df = frames[0]
    for x in frames[1:]:
        df = df.unionByName(x)
    return df.select("file", "begin", "id", strip(F.regexp_replace("value", "^\ufeff", "")).alias("line"))


def first_lines(spark: SparkSession, paths: list[str], count: int) -> DataFrame:
    """The first lines that aren't blank, in the order of files and lines, without moving a line to another task.

    Lines are counted by file, then by split of the file in which the limit falls; only files up to that one are read
    again, and of its last split the lines up to one id.
    """
    full = lambda own: text_lines(spark, own, known).where("line <> ''")
    known = {p: encoding_of(p) for p in paths}
    names = storage.uris(sorted(paths))
    counts = {storage.plain(r.file): r["count"] for r in full(paths).groupBy("file").count().collect()}  # a row a file
    before, whole = 0, []
    for uri, path in sorted(names.items()):
        if before + counts.get(uri, 0) > count:
            break
        before, whole = before + counts.get(uri, 0), [*whole, path]
    else:
        return full(paths)
    last = full([path])
    left = count - before
    for r in sorted(last.groupBy("begin").count().collect()):  # a row a split
        if left < r["count"]:
            end = r.begin
            break
        left -= r["count"]
    edge = last.where(F.col("begin") == end).select("id").orderBy("id").limit(left).agg(F.max("id")).first()[0] if left else -1
    part = last.where((F.col("begin") < end) | ((F.col("begin") == end) & (F.col("id") <= edge)))
    return full(whole).unionByName(part) if whole else part


def json_lines(spark: SparkSession, paths: list[str], strict: bool = True, max_records: int | None = None) -> DataFrame:
    """file, line, record (VARIANT) of every line that isn't blank.

    Strict readers fail on a line that is no JSON object and name its file and split (``bad_line`` finds its number);
    lenient ones leave it out. max_records counts records as they are read, in the order of files and lines.
    """
    df = text_lines(spark, paths).where("line <> ''") if max_records is None else first_lines(spark, paths, max_records)
    df = df.select("file", "begin", "line", F.try_parse_json("line").alias("record"))
    good = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    if strict:
        told = F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(" after byte "), F.col("begin").cast("string"), F.lit(": "), F.substring("line", 1, 80))
        df = df.withColumn("record", F.when(good, F.col("record")).otherwise(F.raise_error(told).cast("variant")))
        return df.select("file", "line", "record")
    return df.where(good).select("file", "line", "record")


def pretrain_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, text of every record that gives one, from JSON lines and Parquet files; a bad line is an error, and so is a gzip file, which can't be cut.

    A Parquet file with a column text is read by that column only, another one by whole rows.
    """
    from millrace.functions.records import pretrain_text

    packed = [p for p in paths if p.endswith(".gz")]
    if packed:
        raise ValueError(f"{packed[0]} is compressed by gzip and can't be read in parts; decompress it first")
    tables = [p for p in paths if p.endswith(".parquet")]
    lines = [p for p in paths if not p.endswith(".parquet")]
    out = [json_lines(spark, lines).select("file", pretrain_text(F.col("record")).alias("text"))] if lines else []
    by: dict[tuple, list[str]] = {}
    for p in tables:
        by.setdefault(tuple(spark.read.parquet(p).dtypes), []).append(p)  # a footer a file
    for own in by.values():
        df = spark.read.parquet(*own)
        file = F.col("_metadata.file_path").alias("file")
        row = F.parse_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
        out.append(df.select(file, F.col("text").cast("string").alias("text")) if "text" in df.columns else df.select(file, row.alias("r")).select("file", pretrain_text(F.col("r")).alias("text")))
    if not out:
        return spark.createDataFrame([], "file string, text string")
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df.select("file", strip(F.col("text")).alias("text")).where("text <> ''")


def bad_line(spark: SparkSession, paths: list[str]) -> None:
    """Fail with path:line at the first line, in the order of files, that is neither blank nor a JSON object."""
    lines = running(text_lines(spark, paths), ["begin", "id"], by=["file"], rank="number", before="_before")
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))
    first = lines.where((F.col("line") != "") & ~good).select("file", "number").orderBy("file", "number").first()
    if first:
        raise ValueError(f"{first.file}:{first.number + 1}: not a JSON object")


def record_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, valid, invalid: records that give a text and those that don't, counted and not raised."""
    from millrace.functions.records import pretrain_text

    rows = text_lines(spark, paths).where("line <> ''").select("file", F.try_parse_json("line").alias("v"))
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    text = F.when(good, strip(pretrain_text(F.col("v"))))
    valid = F.coalesce(text != "", F.lit(False))
    return rows.select("file", valid.alias("ok")).groupBy("file").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


def parquet_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """text of Parquet files that have it (other columns are not read, nulls go); else whole rows as JSON lines."""
    df = spark.read.parquet(*paths)
    if "text" in df.columns:
        return df.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).withColumn("record", F.parse_json("line"))


def metric_log(spark: SparkSession, paths: list[str], phase: str = "unknown") -> DataFrame:
    """Lenient reading of metric logs: lines that are no objects are left out, a missing phase gets the default."""
    log = json_lines(spark, paths, strict=False)
    number = lambda k: F.try_variant_get("record", f"$.{k}", "double").alias(k)
    text = lambda k: F.try_variant_get("record", f"$.{k}", "string")
    return log.select("file", "line", text("stage").alias("stage"), *(number(k) for k in ("step", "tokens", "loss", "val_loss", "ppl", "val_ppl", "grad_norm")), F.coalesce(text("_dashboard_phase"), F.lit(phase)).alias("phase"))


def mixture(entries: list[dict], val_docs: int = 0) -> list[dict]:
    """Checked entries of a mixture manifest: unique names, positive weights."""
    names = [e["name"] for e in entries]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"corpus names occur twice: {', '.join(twice)}")
    for e in entries:
        if not float(e.get("weight", 1)) > 0:
            raise ValueError(f"the weight of {e['name']} must be positive")
    return [{"weight": 1.0, "val_docs": val_docs} | e for e in entries]


def load_json(path: str) -> dict:
    return json.loads(storage.read_text(path))
