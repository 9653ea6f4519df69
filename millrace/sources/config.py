"""Configuration files, manifests with relative paths, and their checks."""

from __future__ import annotations

import json
from pathlib import Path

SEED_STEP = 1009


def load_config(path: str) -> dict:
    """A JSON or YAML file; an empty one is an empty configuration."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the yaml package; give the configuration as JSON") from e
    return yaml.safe_load(text) or {}


def settings(config: dict, under: str = "") -> dict:
    """Every value of a nested configuration by its dotted path, sections too."""
    out = {}
    for k, v in config.items():
        out[f"{under}{k}"] = v
        if isinstance(v, dict):
            out |= settings(v, f"{under}{k}.")
    return out


def beside(path: str, base: str) -> str:
    """path, or the path under base if it is relative."""
    return str(path) if Path(path).is_absolute() else str(Path(base) / path)


def project_file(config: dict, key: str, default: str, smoke: bool = False) -> str:
    """A path of the project section; smoke runs may have one of their own."""
    every = settings(config)
    return str(smoke and every.get(f"smoke.{key}") or every.get(f"project.{key}", default))


def check_keys(config: dict, known: set[str]) -> None:
    unknown = sorted(set(config) - known)
    if unknown:
        raise ValueError(f"unknown configuration keys: {', '.join(unknown)}")


# The sizes of a model, those that 8-bit products need in sixteens, and the choices that settings have (the first is the default).
SIZES = ("vocab_size", "block_size", "n_layer", "n_head", "n_kv_head", "n_embd", "n_expert", "expert_hidden_size", "shared_expert_hidden_size")
SIXTEENS = ("n_embd", "expert_hidden_size", "shared_expert_hidden_size")
CHOICES = {
    "router_gemm_precision": ("float32", "bfloat16"),
    "te_grouped_linear_backend": ("legacy", "ops"),
    "linear_cross_entropy_backend": ("auto", "standard", "liger", "checkpointed"),
}


def model_faults(config: dict) -> list[str]:
    """All rules that a model configuration breaks."""
    found = [f"{k} must be a positive integer" for k in SIZES if not isinstance(config.get(k), int) or config[k] <= 0]
    if found:
        return found
    width, heads, groups = (config[k] for k in ("n_embd", "n_head", "n_kv_head"))
    rules = {
        "n_embd must be a multiple of n_head": width % heads == 0,
        "n_head must be a multiple of n_kv_head": heads % groups == 0,
        "the size of a head must be even": width // heads % 2 == 0,
        "top_k must be 1": config.get("top_k", 1) == 1,
        "linear_cross_entropy_chunk_size must be positive": config.get("linear_cross_entropy_chunk_size", 2048) > 0,
        "dropout must be in [0, 1)": 0 <= config.get("dropout", 0.0) < 1,
        **{f"{k} must be a multiple of 16": config[k] % 16 == 0 for k in SIXTEENS},
        **{f"{k} must be one of {', '.join(v)}": config.get(k, v[0]) in v for k, v in CHOICES.items()},
    }
    return [rule for rule, holds in rules.items() if not holds]


def check_model(config: dict) -> None:
    """Fail on a model configuration that can't be built, with every broken rule."""
    found = model_faults(config)
    if found:
        raise ValueError("; ".join(found))


def check_special_ids(ids: dict[str, int | None], wanted: dict[str, int]) -> None:
    """Fail if a tokenizer gives special tokens other ids than the configuration."""
    wrong = sorted(t for t, i in wanted.items() if ids.get(t) != i)
    if wrong:
        raise ValueError(f"special tokens with other ids: {', '.join(wrong)}")


def read_mixture(path: str, seed: int, val_docs: int = 100) -> list[dict]:
    """Corpora of a mixture manifest: name, path, weight, val_docs, seed. Relative paths start at the manifest's folder."""
    from millrace.sources.files import mixture

    manifest = load_config(path)
    entries = manifest.get("corpora") or []
    if not entries:
        raise ValueError(f"no corpora in {path}")
    own = [{"name": e.get("name", Path(e["path"]).name), **e, "path": beside(e["path"], str(Path(path).parent))} for e in entries]
    return [e | {"seed": seed + SEED_STEP * i} for i, e in enumerate(mixture(own, int(manifest.get("val_docs_per_corpus", val_docs))))]


def merge_mixture(running: list[dict], found: list[dict]) -> list[dict]:
    """The running corpora with new ones behind. A name under another path, or a path under another name, is an error."""
    path_of, name_of = {c["name"]: c["path"] for c in running}, {c["path"]: c["name"] for c in running}
    out = list(running)
    for c in found:
        if path_of.get(c["name"], c["path"]) != c["path"]:
            raise ValueError(f"corpus {c['name']} has another path")
        if name_of.get(c["path"], c["name"]) != c["name"]:
            raise ValueError(f"{c['path']} is known as {name_of[c['path']]}")
        if c["name"] not in path_of:
            out.append(c)
            path_of[c["name"]], name_of[c["path"]] = c["path"], c["name"]
    return out
