"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are what strict patterns find: e-mail and IP addresses, payment cards (Luhn), phone
numbers. Every seed is an instance with the words left of it as its lexical pattern; so is every
other token with a digit or an at sign, of the kind its loose shape suggests or of none.
Pattern-instance edges are counted, then scored in turns:

    score(pattern, kind) = sum of the belief in its instances of that kind / (its instances + 1)
    belief(instance, kind) = 1 for seeds, else 1 - product of (1 - score) over its patterns
                             that score at least PATTERN_SCORE

After ROUNDS turns, tokens whose instance is believed at least INSTANCE_BELIEF, standing in a
pattern of at least PATTERN_SCORE, are added as spans of that kind. Strict spans always stay.

Strict patterns are written so that Java's matcher is linear: possessive repeats, and starts
only at the beginning of a run or where the last match ended. Positions come from splitting
the text by a pattern and adding up code-point lengths of what lies between and the matches;
spans are made in runs and compared in order, so that a text with many matches stays linear.

Cases: a null or empty text has no spans; a null id stays null; repeated rows are reported each,
and count as one edge; a failing strict match consumes its characters; an empty table gives
an empty result; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.llm import common

ROUNDS = 3
PATTERN_SCORE = 0.75
INSTANCE_BELIEF = 0.75
#: A pattern needs so many instances to teach anything; this is a rule of evidence, not a cap.
LEAST_INSTANCES = 5
#: Characters left of a span in which its two words are looked for.
CONTEXT = 80
KINDS = ("email", "ip", "card", "phone")
# The strict patterns, with possessive repeats and anchored starts.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_ONE_SPAN = "struct<s:int,e:int,v:string,l:string>"
#: Elements of a run of a fold.
FOLD = 256


def _located(text: Column, pattern: str, possible: Column) -> tuple[Column, Column]:
    """What lies before each match (and after the last), and the matches."""
    return (
        F.when(possible, F.split(text, pattern, -1)).otherwise(F.array(F.lit(""))),
        F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")),
    )


def _folded(count: Column, state: Column, kind: str, step) -> Column:
    """The array of what step(state, i) gives for i below count, beside the next state, in time linear but for FOLD.

    An array that grows by one is copied each time, so runs of FOLD elements are made first and put together at the end.
    """
    empty = F.array().cast(f"array<{kind}>")

    def one(a, i):
        after, element = step(a["s"], i)
        return F.struct(after.alias("s"), F.array_append(a["out"], element).alias("out"))

    def run(a, c):
        own = F.aggregate(F.sequence(c * FOLD, F.least(count, (c + 1) * FOLD) - 1), F.struct(a["s"].alias("s"), empty.alias("out")), one)
        return let(own, lambda x: F.struct(x["s"].alias("s"), F.array_append(a["out"], x["out"]).alias("out")))

    runs = F.sequence(F.lit(0), F.floor((F.greatest(count, F.lit(1)) - 1) / FOLD).cast("int"))
    whole = F.aggregate(runs, F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out")), run, lambda a: F.flatten(a["out"]))
    return F.when(count > 0, whole).otherwise(empty)


def _spans(p: str, m: str) -> Column:
    """Start, end, text and left context of each match, in code points."""

    def step(at, i):
        before, match = F.get(p, i), F.get(m, i)
        start = at + F.length(before)
        end = start + F.length(match)
        return end, F.struct(start.alias("s"), end.alias("e"), match.alias("v"), F.substring(before, -CONTEXT, CONTEXT).alias("l"))

    return _folded(F.size(m), F.lit(0), _ONE_SPAN, step)


def _clear(spans: str, base: str) -> tuple[Column, Column]:
    """Numbers of the spans (in order, disjoint) that no base span overlaps, by one pass over all of them in order, which is to be the column _events."""
    place = lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), i.cast("int").alias("i"))
    last = F.array(place({"s": F.lit(2**31 - 1), "e": F.lit(2**31 - 1)}, F.size(spans)))  # brings the last one out
    events = F.array_sort(F.concat(F.transform(base, lambda x: place(x, F.lit(-1))), F.transform(spans, place), last))
    state = F.struct(F.lit(0).alias("reach"), F.lit(-1).alias("i"), F.lit(0).alias("e"), F.lit(False).alias("hit"))

    def step(a, j):
        x = F.get("_events", j)
        found = F.struct(F.greatest(a["reach"], x["e"]).alias("reach"), a["i"].alias("i"), a["e"].alias("e"), (a["hit"] | (x["s"] < a["e"])).alias("hit"))
        opened = F.struct(a["reach"].alias("reach"), x["i"].alias("i"), x["e"].alias("e"), (x["s"] < a["reach"]).alias("hit"))
        return F.when(x["i"] < 0, found).otherwise(opened), F.when((x["i"] < 0) | a["hit"], -1).otherwise(a["i"])

    return events, F.filter(_folded(F.size("_events"), state, "int", step), lambda i: i >= 0)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))

    def step(total, i):
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.when(F.length(d).between(13, 19), F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0).otherwise(False)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _loose(v: Column) -> Column:
    """The kind a token's loose shape suggests, -1 for none."""
    n = F.length(_digits(v))
    return (
        F.when(v.rlike(r"^[^@]+@[^@]+$"), 0)
        .when(v.rlike(r"^[^0-9]*[0-9]+(?:[.:][0-9]+){3,7}[^0-9]*$"), 1)
        .when(n.between(12, 19) & v.rlike(r"^[0-9 -]+$"), 2)
        .when(n.between(7, 15) & v.rlike(r"^[+(]?[0-9().-]+$"), 3)
        .otherwise(-1)
    )


def _pattern(left: Column) -> Column:
    """The last two words of a left context, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_extract(left, r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]*[\x20\x09-\x0D]*\z", 0), r"[\x20\x09-\x0D]+", " ")))


def _checked(number: int, kind: str) -> Column:
    """The strict spans of one kind that hold, with that kind's number and their patterns."""
    held = F.filter(_spans(f"p_{kind}", f"m_{kind}"), lambda x: _VALID[kind](x["v"]))
    return F.transform(held, lambda x: F.struct(F.lit(number).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), _pattern(x["l"]).alias("l")))


def _count(number: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == number)).cast("long")


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, row, base (strict spans by kind), loose (other tokens with digits or an at sign)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    may = {"email": F.col("_t").contains("@"), "ip": F.col("_t").rlike(r"[0-9]\.[0-9]"), "card": F.col("_t").rlike("[0-9][0-9 -][0-9]"), "phone": F.col("_t").contains("+")}
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"), *keep)
    cells = []
    for k in KINDS:
        p, m = _located(F.col("_t"), STRICT[k], may[k])
        cells += [p.alias(f"p_{k}"), m.alias(f"m_{k}")]
    p, m = _located(F.col("_t"), _TOKEN, F.col("_t").rlike("[0-9@]"))
    df = df.select("doc_id", *keep, *cells, p.alias("p_t"), m.alias("m_t"))
    base = F.concat(*(_checked(i, k) for i, k in enumerate(KINDS)))
    df = df.select("doc_id", *keep, base.alias("base"), _spans("p_t", "m_t").alias("t"))

    def bare(x):
        v = F.regexp_replace(x["v"], r"^[^\p{L}0-9+(]+|[^\p{L}0-9]+$", "")
        lead = F.length(x["v"]) - F.length(F.regexp_replace(x["v"], r"^[^\p{L}0-9+(]+", ""))
        start = x["s"] + lead
        return F.struct(_loose(v).alias("k"), start.alias("s"), (start + F.length(v)).alias("e"), v.alias("v"), _pattern(x["l"]).alias("l"))

    df = df.select("doc_id", *keep, "base", F.filter(F.transform("t", bare), lambda x: x["e"] > x["s"]).alias("_b"))
    events, clear = _clear("_b", "base")
    df = df.select("*", events.alias("_events")).select("doc_id", *keep, "base", "_b", clear.alias("_clear"))
    return df.select("doc_id", *keep, "base", F.transform("_clear", lambda i: F.get("_b", i)).alias("loose"), F.monotonically_increasing_id().alias("row"))


def learn(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score) of the patterns that score enough; (instance, kind, belief) of the instances believed enough."""
    spark = found.sparkSession
    both = F.concat(F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"), x["l"].alias("l"), F.lit(1.0).alias("seed"))), F.transform("loose", lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"), x["l"].alias("l"), F.lit(0.0).alias("seed"))))
    edges = found.select(F.explode(both).alias("x")).select(F.col("x.l").alias("pattern"), F.col("x.k").alias("kind"), F.lower("x.v").alias("instance"), "x.seed").where("pattern <> ''")
    edges = common.written(edges.groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed")), spark)
    size = edges.groupBy("pattern").agg(F.count("*").alias("m"), F.sum("seed").alias("seeds")).where((F.col("m") >= LEAST_INSTANCES) & (F.col("seeds") > 0))
    graph = common.written(edges.join(size.select("pattern", "m"), "pattern").withColumn("belief", F.col("seed")), spark)
    patterns = beliefs = None
    for turn in range(rounds):
        now = graph if beliefs is None else graph.join(beliefs.withColumnRenamed("belief", "b"), ["instance", "kind"], "left").withColumn("belief", F.greatest("seed", F.coalesce("b", F.lit(0.0)))).drop("b")
        patterns = common.written(
            now.where("kind >= 0").groupBy("pattern", "kind").agg((F.sum("belief") / (F.first("m") + 1)).alias("score")).where(F.col("score") >= PATTERN_SCORE), spark
        )
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12))))
        beliefs = common.written(graph.where("seed = 0 AND kind >= 0").join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("belief")).where(F.col("belief") >= INSTANCE_BELIEF), spark)
    return patterns, beliefs


def spans(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, row, base and all (array of kind, start, end; by kind, then start) of every row, with the columns to keep."""
    spark = docs.sparkSession
    found = common.written(scan(docs, *keep), spark)
    patterns, beliefs = learn(found.select("base", "loose"))
    loose = found.select("row", F.explode("loose").alias("x")).select("row", F.col("x.k").alias("kind"), F.lower("x.v").alias("instance"), F.col("x.l").alias("pattern"), "x.s", "x.e").where("kind >= 0 AND pattern <> ''")
    added = loose.join(patterns, ["pattern", "kind"], "left_semi").join(beliefs, ["instance", "kind"], "left_semi")
    added = added.groupBy("row").agg(F.collect_list(F.struct(F.col("kind").alias("k"), "s", "e")).alias("more"))
    base = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    both = F.concat(base, F.coalesce("more", F.array().cast("array<struct<k:int,s:int,e:int>>")))
    return found.join(added, "row", "left").select("doc_id", "row", *keep, base.alias("base"), F.array_sort(both).alias("all"))


def _shown(c: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of every row's spans."""
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans(docs).select("doc_id", *counts, F.sha2(_shown("base"), 256).alias("base_sha256"), _shown("all").alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; overlapping spans become one, and n_chars follows the text."""
    rest = [c for c in docs.columns if c != "doc_id"]
    renamed = docs.select("doc_id", "text", *(F.col(c).alias(f"_k{i}") for i, c in enumerate(rest)))
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform("all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    text = f"_k{rest.index('text')}"

    def step(a, x):
        new = F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, x["s"] - a["at"]), F.element_at(marks, x["k"] + 1))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(by_start, zero, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    out = spans(renamed, *(f"_k{i}" for i in range(len(rest)))).withColumn(text, F.when(F.size("all") > 0, clean).otherwise(F.col(text)))
    if "n_chars" in rest:  # it is the length of the text
        chars = f"_k{rest.index('n_chars')}"
        out = out.withColumn(chars, F.when(F.size("all") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(chars)))
    return out.select(*(F.col("doc_id").cast(docs.schema["doc_id"].dataType) if c == "doc_id" else F.col(f"_k{rest.index(c)}").alias(c) for c in docs.columns))


def op8(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))
