"""Supervised and preference examples: masks, label windows, padding, collation.

Token ids come from any encoder that gives an array column; ``byte_ids`` is one id a UTF-8 byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.records import format_prompt
from millrace.functions.text import let, rstrip

IGNORE = -100
EOS = 256


def byte_ids(text: Column) -> Column:
    """One id for each UTF-8 byte, in time linear in the text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def _constant(value, n: Column) -> Column:
    return F.transform(F.array_repeat(F.lit(0), n.cast("int")), lambda _: F.lit(value))


def sft_messages(messages: Column, encode=byte_ids, eos: int = EOS) -> Column:
    """ids and mask of a conversation: headers unsupervised, assistant content and the end id after it supervised."""

    def part(m):
        own = m["role"] == "assistant"
        tail = F.when(own, F.array(F.lit(eos))).otherwise(F.array().cast("array<int>"))
        both = F.struct(encode(F.concat(F.lit("<|"), m["role"], F.lit("|>\n"))).alias("h"), F.concat(encode(F.concat(m["content"], F.lit("\n"))), tail).alias("r"))
        return let(both, lambda x: F.struct(F.concat(x["h"], x["r"]).alias("ids"), F.concat(_constant(False, F.size(x["h"])), F.transform(x["r"], lambda _: own)).alias("mask")))

    parts = F.transform(messages, part)
    return F.struct(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), F.flatten(F.transform(parts, lambda p: p["mask"])).alias("mask"))


def sft_flat(prompt: Column, response: Column, encode=byte_ids, eos: int = EOS) -> Column:
    """ids and mask of a pair; the two regions are encoded by themselves, so that no merge crosses them."""
    both = F.struct(encode(format_prompt(prompt)).alias("h"), F.concat(encode(rstrip(response)), F.array(F.lit(eos))).alias("r"))
    return let(both, lambda x: F.struct(F.concat(x["h"], x["r"]).alias("ids"), F.concat(_constant(False, F.size(x["h"])), _constant(True, F.size(x["r"]))).alias("mask")))


def usable(example: Column) -> Column:
    """At least two ids and one of them supervised."""
    return (F.size(example["ids"]) >= 2) & F.exists(example["mask"], lambda x: x)


def shifted(ids: Column, mask: Column | None = None) -> tuple[Column, Column]:
    """Inputs and next-token labels; labels that aren't supervised are IGNORE."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    inputs, labels = F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)
    if mask is not None:
        labels = F.zip_with(labels, F.slice(mask, F.lit(2), n), lambda x, m: F.when(m, x).otherwise(F.lit(IGNORE)))
    return inputs, labels


def dpo_example(prompt: Column, response: Column, longest: int, encode=byte_ids, eos_text: str = "<|eos|>") -> Column:
    """inputs and labels of one side of a pair, cut to ``longest`` predictions; NULL if nothing is left to learn."""
    both = F.struct(encode(format_prompt(prompt)).alias("h"), encode(F.concat(rstrip(response), F.lit(eos_text))).alias("r"))

    def cut(x):
        return F.struct(F.size(x["h"]).alias("h"), F.slice(F.concat(x["h"], x["r"]), 1, longest + 1).alias("full"))

    def label(x):
        inputs, labels = shifted(x["full"])
        told = F.transform(labels, lambda y, i: F.when(i < x["h"] - 1, F.lit(IGNORE)).otherwise(y))
        return F.when((F.size(x["full"]) >= 2) & (x["h"] < F.size(x["full"])), F.struct(inputs.alias("inputs"), told.alias("labels")))

    # a head shorter than the whole leaves at least one label
    return let(let(both, cut), label)


def padded(ids: Column, width: Column, pad) -> Column:
    return F.concat(ids, _constant(pad, F.greatest(width - F.size(ids), F.lit(0))))


def pad_width(longest: Column, multiple: int = 16) -> Column:
    return F.when(F.lit(multiple) > 1, (F.ceil(longest / multiple) * multiple).cast("int")).otherwise(longest)


def collate(pairs: DataFrame, batch: int, pad: int = 0, multiple: int = 16) -> DataFrame:
    """Interleaved, padded batches of pairs. pairs: example (0-based rank), chosen, rejected (inputs and labels)."""
    side = lambda name, place: F.struct(F.lit(place).alias("side"), F.col(name)["inputs"].alias("inputs"), F.col(name)["labels"].alias("labels"))
    rows = pairs.select(F.floor(F.col("example") / batch).cast("long").alias("batch"), "example", F.explode(F.array(side("chosen", 0), side("rejected", 1))).alias("s"))
    own = F.array_sort(F.collect_list(F.struct("example", "s")))  # two rows for each of at most ``batch`` examples
    out = rows.groupBy("batch").agg(own.alias("r"), F.max(F.size("s.inputs")).alias("longest"), F.min(F.size("s.inputs")).alias("shortest"), F.count("*").alias("rows"))
    even = (F.col("rows") == 2) & (F.col("longest") == F.col("shortest"))
    width = F.when(even, F.col("longest")).otherwise(pad_width(F.col("longest"), multiple))
    lengths = F.transform("r", lambda x: F.size(x["s"]["inputs"]))
    sums = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    needed = F.exists(lengths, lambda n: n != F.col("width"))
    return out.withColumn("width", width).select(
        "batch", "width",
        F.transform("r", lambda x: padded(x["s"]["inputs"], F.col("width"), pad)).alias("inputs"),
        F.transform("r", lambda x: padded(x["s"]["labels"], F.col("width"), IGNORE)).alias("labels"),
        F.when(needed, sums).alias("cu_seqlens"),
    )
