"""Command line: ``python -m millrace build|sample|tokenizer|qa``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from millrace.functions.records import pretrain_text
from millrace.functions.text import strip
from millrace.operators import bpe, sampling
from millrace.session import session
from millrace.sources import corpus, files, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    sub = top.add_subparsers(dest="command", required=True)
    own = {c: sub.add_parser(c) for c in ("build", "sample", "tokenizer", "qa")}
    for c in ("build", "sample", "tokenizer"):
        own[c].add_argument("--input", required=True)
        own[c].add_argument("--output", required=True)
        own[c].add_argument("--exclude", nargs="*", default=[])
    own["build"].add_argument("--tokenizer", required=True)
    own["build"].add_argument("--name", required=True)
    own["build"].add_argument("--eos", default="<|eos|>")
    own["build"].add_argument("--fresh", action="store_true")
    own["sample"].add_argument("--manifest", required=True)
    own["sample"].add_argument("--samples-per-file", type=int, default=500)
    own["sample"].add_argument("--seed", type=int, default=20260725)
    own["tokenizer"].add_argument("--vocab-size", type=int, default=32768)
    own["tokenizer"].add_argument("--special", nargs="*", default=["<|pad|>", "<|bos|>", "<|eos|>", "<|unk|>", "<|user|>", "<|assistant|>", "<|system|>"])
    own["tokenizer"].add_argument("--allow-smaller-vocab", action="store_true")
    own["qa"].add_argument("--tokenizer", required=True)
    own["qa"].add_argument("--text", nargs="+", required=True)
    own["qa"].add_argument("--eos", default="<|eos|>")
    return top


def texts(spark, root: str, exclude, strict: bool = True):
    """file and text of every record under root that gives one; a line that is no object is an error, or left out."""
    lines = files.json_lines(spark, files.sample_files(root, exclude), strict)
    return lines.select("file", strip(pretrain_text(F.col("record"))).alias("text")).where("text <> ''")


def main(argv: list[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = session("millrace")
    if a.command == "build":
        from millrace.functions.hashing import streamed_sha256

        eos = bpe.token_id(a.tokenizer, a.eos)
        from tokenizers import Tokenizer

        size = Tokenizer.from_file(a.tokenizer).get_vocab_size()
        out = corpus.build_corpus(spark, files.listed(a.input, exclude=a.exclude), a.output, lambda rows: bpe.encode(rows, a.tokenizer, eos), a.name, size, streamed_sha256(a.tokenizer), eos, a.fresh)
    elif a.command == "sample":
        found = files.sample_files(a.input, a.exclude)
        rows = texts(spark, a.input, a.exclude, strict=False).withColumnRenamed("file", "source_file").withColumn("key", F.sha2("text", 256))
        sample = sampling.by_hash(rows, "source_file", "key", a.samples_per_file, a.seed).drop("key")
        bytes_of = sample.groupBy("source_file").agg(F.sum(F.octet_length("text")).cast("long").alias("sample_bytes"))
        counts = files.record_counts(spark, found).select(F.col("file").alias("source_file"), F.col("valid").alias("valid_documents"), F.col("invalid").alias("invalid_records"))
        out = sinks.write_sample(sample, a.output, a.manifest, counts.join(bytes_of, "source_file", "left"))
    elif a.command == "tokenizer":
        wanted = a.vocab_size - 256 - len(a.special)
        merges = bpe.train(texts(spark, a.input, a.exclude), wanted)
        if len(merges) < wanted and not a.allow_smaller_vocab:
            raise ValueError(f"the texts give {len(merges)} merges of {wanted}")
        bpe.save(merges, a.special, a.output)
        out = {"vocab_size": 256 + len(a.special) + len(merges)}
    else:
        eos = bpe.token_id(a.tokenizer, a.eos)
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(a.text)], "probe int, text string")
        got = bpe.decode(bpe.encode(rows, a.tokenizer, eos), a.tokenizer, eos)
        out = {"probes": [{"probe": r.probe, "tokens": r.n_tokens - 1, "exact": r.decoded == r.text.strip()} for r in got.collect()]}
    print(json.dumps(out, ensure_ascii=False))
    return out


if __name__ == "__main__":
    main()
