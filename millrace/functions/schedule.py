"""Schedules over steps and the arithmetic of token budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_lr(step: Column, max_steps: int, warmup: int, peak: float, least: float) -> Column:
    """Linear warm-up, then half a cosine down to ``least``."""
    ratio = (step - warmup) / F.lit(float(max(1, max_steps - warmup)))
    return (
        F.when(step < warmup, F.lit(peak) * (step + 1) / F.lit(float(max(1, warmup))))
        .when(step >= max_steps, F.lit(least))
        .otherwise(F.lit(least) + F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * ratio)) * F.lit(peak - least))
    )


def scheduled(progress: Column, schedule: list[dict], key: str, default: int) -> Column:
    """The key's value in the first entry whose ``until`` lies beyond progress; entries without it keep the last value."""
    value, cases = default, []
    for item in schedule:
        value = int(item.get(key, value))
        cases.append((float(item.get("until", 1.0)), value))
    out = F.lit(value)
    for until, v in reversed(cases):
        out = F.when(progress < until, v).otherwise(out)
    return out


def target_tokens(configured: int, explicit: int | None = None, budget: float | None = None, price_per_hour: float | None = None, tokens_per_second: float | None = None, reserve: float = 0.0, safety: float = 0.95) -> int:
    """Tokens to train on: those asked for, those the budget buys, or the configured ones."""
    if explicit is not None:
        return int(explicit)
    told = (budget, price_per_hour, tokens_per_second)
    if all(x is None for x in told):
        return int(configured)
    if any(x is None for x in told):
        raise ValueError("budget, price and throughput must be given together")
    if not 0 < safety <= 1:
        raise ValueError("the safety factor must be in (0, 1]")
    return max(1, int(max(0.0, budget - reserve) / price_per_hour * 3600 * tokens_per_second * safety))


def steps_for(tokens: int, tokens_per_step: int, one_epoch: bool = False) -> int:
    """Optimizer steps: a single epoch drops its tail, a budget is rounded up."""
    steps = tokens // tokens_per_step if one_epoch else -(-tokens // tokens_per_step)
    if steps < 1:
        raise ValueError("not enough data for one step")
    return steps
