"""Heterogeneous JSON records to canonical text, as expressions over a VARIANT column.

An absent key and a null are different things here: a fallback key is looked up only where the
first key is absent. Numbers inside structured payloads are printed as Spark prints variants.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let, rstrip, strip

# Role names that stand for others.
ROLE_ALIASES = {"human": "user", "instruction": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
# A prompt that holds one of these is already formatted.
PROMPT_MARKERS = ("<|user|>", "<|system|>", "<|developer|>", "<|tool|>", "<|observation|>", "<|function|>")
MESSAGES = "array<struct<role:string,content:string>>"


def get(v: Column, key: str) -> Column:
    """The value at key: NULL if the key is absent, a variant null if it is null."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def filled(x: Column) -> Column:
    return x.isNotNull() & ~F.coalesce(F.is_variant_null(x), F.lit(False))


def kind(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x), F.lit(""))


def as_text(x: Column) -> Column:
    """A scalar as its Python text: None, True and False are spelled so."""
    k = kind(x)
    return F.when(F.is_variant_null(x), "None").when(k == "BOOLEAN", F.initcap(x.cast("string"))).when(k.startswith("OBJECT") | k.startswith("ARRAY"), F.to_json(x)).otherwise(x.cast("string"))


def first_filled(v: Column, *keys: str) -> Column:
    """Text of the first key that is neither absent nor null."""
    return F.coalesce(*(F.when(filled(get(v, k)), as_text(get(v, k))) for k in keys))


def message_content(m: Column) -> Column:
    """Content, then name and call id, tool calls and function call, a line each; what is missing is left out."""
    raw = F.when(get(m, "content").isNotNull(), get(m, "content")).otherwise(get(m, "value"))
    body = F.when(~filled(raw), "").when(kind(raw) == "STRING", raw.cast("string")).otherwise(F.to_json(raw))
    pairs = F.array_compact(F.array(*(F.when(filled(get(m, k)), F.concat(F.lit(f'"{k}":'), F.to_json(get(m, k)))) for k in ("name", "tool_call_id"))))
    wrap = lambda open_, c, close: F.concat(F.lit(open_), c, F.lit(close))
    return F.concat_ws(
        "\n",
        F.when(body != "", body),
        F.when(F.size(pairs) > 0, wrap("<|json_start|>{", F.array_join(pairs, ","), "}<|json_end|>")),
        F.when(filled(get(m, "tool_calls")), wrap("<|tool_call|>", F.to_json(get(m, "tool_calls")), "<|tool_call_end|>")),
        F.when(filled(get(m, "function_call")), wrap("<|function_call|>", F.to_json(get(m, "function_call")), "")),
    )


def message_role(m: Column) -> Column:
    raw = F.when(get(m, "role").isNotNull(), as_text(get(m, "role"))).when(get(m, "from").isNotNull(), as_text(get(m, "from"))).otherwise("user")
    aliases = F.create_map(*(F.lit(x) for pair in ROLE_ALIASES.items() for x in pair))
    return let(F.lower(strip(raw)), lambda name: F.when(name == "", "user").otherwise(F.coalesce(F.element_at(aliases, name), name)))


def conversation(v: Column) -> Column:
    """The list under messages, or under conversations where messages is absent; NULL if it is no list."""
    raw = F.when(get(v, "messages").isNotNull(), get(v, "messages")).otherwise(get(v, "conversations"))
    return F.when(kind(raw).startswith("ARRAY"), F.try_variant_get(raw, "$", "array<variant>"))


def normalize(messages: Column) -> Column:
    """Roles and contents of the objects in a list; objects that say nothing go."""
    objects = F.filter(messages, lambda m: kind(m).startswith("OBJECT"))
    told = F.transform(objects, lambda m: F.struct(message_role(m).alias("role"), message_content(m).alias("content"), (get(m, "role").isNotNull() | get(m, "from").isNotNull()).alias("named")))
    kept = F.filter(told, lambda m: (m["content"] != "") | m["named"])
    return F.transform(kept, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def render(messages: Column) -> Column:
    """Normalized messages as text."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n")


def last_assistant(messages: Column) -> Column:
    """1-based place of the last assistant turn; 0 without one."""
    at = F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i + 1).otherwise(0))
    return F.coalesce(F.array_max(at), F.lit(0))


def response_of(messages: Column) -> Column:
    """prompt (the rendered prefix) and text of the last assistant turn; both NULL without one."""

    def told(x):
        at = x["at"]
        prompt = F.when(at > 0, render(F.slice(x["m"], F.lit(1), F.greatest(at - 1, F.lit(0)))))
        return F.struct(prompt.alias("prompt"), F.when(at > 0, F.element_at(x["m"], F.greatest(at, F.lit(1)))["content"]).alias("text"), (at > 0).alias("spoken"))

    return let(let(messages, lambda m: F.struct(m.alias("m"), last_assistant(m).alias("at"))), told)


def _flat_prompt(v: Column) -> Column:
    extra = F.when(get(v, "input").isNotNull(), as_text(get(v, "input"))).otherwise("")
    told = as_text(get(v, "instruction"))
    asked = F.when(filled(get(v, "instruction")), F.when(strip(extra) != "", F.concat(told, F.lit("\n"), extra)).otherwise(told))
    return F.coalesce(first_filled(v, "prompt", "question"), asked)


def sft_pair(v: Column) -> Column:
    """prompt and response of a record, each NULL where there is none."""

    def told(x):
        return F.struct(
            F.when(x["spoken"], x["prompt"]).otherwise(F.coalesce(_flat_prompt(v), first_filled(v, "input"))).alias("prompt"),
            F.when(x["spoken"], x["text"]).otherwise(first_filled(v, "response", "answer", "output", "completion")).alias("response"),
        )

    return let(response_of(normalize(conversation(v))), told)


def _choice(v: Column, *keys: str) -> Column:
    raw = F.coalesce(*(F.when(filled(get(v, k)), get(v, k)) for k in keys))
    return let(raw, lambda r: F.when(kind(r).startswith("ARRAY"), let(response_of(normalize(F.try_variant_get(r, "$", "array<variant>"))), lambda x: F.struct(x["prompt"].alias("prompt"), x["text"].alias("text")))).otherwise(F.struct(F.lit(None).cast("string").alias("prompt"), as_text(r).alias("text"))))


def dpo_triplet(v: Column) -> Column:
    """prompt, chosen, rejected; a prompt is taken from the chosen list only if there is no other."""
    both = F.struct(_choice(v, "chosen", "accepted", "winner").alias("c"), _choice(v, "rejected", "reject", "loser").alias("r"))
    return let(both, lambda x: F.struct(F.coalesce(_flat_prompt(v), x["c"]["prompt"]).alias("prompt"), x["c"]["text"].alias("chosen"), x["r"]["text"].alias("rejected")))


def format_prompt(prompt: Column) -> Column:
    """The prompt with a user header, unless it has a role marker, and an assistant header to go on from."""

    def told(p):
        marked = F.lit(False)
        for m in PROMPT_MARKERS:
            marked = marked | p.contains(m)
        return F.concat(F.when(marked, "").otherwise("<|user|>\n"), rstrip(p), F.lit("\n<|assistant|>\n"))

    return let(prompt, told)


def format_sft(prompt: Column, response: Column, eos: str = "<|eos|>") -> tuple[Column, Column]:
    prefix = format_prompt(prompt)
    return prefix, F.concat(prefix, rstrip(response), F.lit(eos))


def pretrain_text(v: Column, line: Column | None = None) -> Column:
    """text; else the rendered conversation; else the pair; else the record's own JSON (``line`` as it came)."""
    own = F.to_json(v) if line is None else line
    paired = let(sft_pair(v), lambda x: F.when(x["prompt"].isNotNull() & x["response"].isNotNull(), F.concat(F.lit("<|user|>\n"), x["prompt"], F.lit("\n<|assistant|>\n"), x["response"])))
    spoken = let(conversation(v), lambda c: F.when(c.isNotNull(), render(normalize(c))))
    return F.coalesce(F.when(filled(get(v, "text")), as_text(get(v, "text"))), spoken, paired, own)
