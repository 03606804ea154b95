"""Column expressions for scores, budgets, schedules and display forms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SCORE = 1000


def white_score(relative: Column, mate_in: Column, white_to_move: Column, most: int = MAX_SCORE) -> Column:
    """White's score from the mover's: mates are the most, the mated side loses, centipawns are clamped."""
    sign = F.when(white_to_move, 1).otherwise(-1)
    mate = F.when(mate_in == 0, -sign).when(mate_in > 0, sign).otherwise(-sign) * most
    return F.when(mate_in.isNotNull(), mate).otherwise(F.greatest(F.least(sign * relative, F.lit(most)), F.lit(-most)))


def compute_budget(tau: float | None = None, days: float | None = None, params: float | None = None, tokens: float | None = None) -> float:
    """The missing one of tau (1e12 flop/s), days, params (millions) and tokens (billions) in tau * time = 6 * params * tokens."""
    if sum(x is None for x in (tau, days, params, tokens)) != 1:
        raise ValueError("exactly one of tau, days, params and tokens must be missing")
    scale = {"tau": 1e12, "days": 86400.0, "params": 1e6, "tokens": 1e9}
    if tau is None:
        return 6 * params * scale["params"] * tokens * scale["tokens"] / (days * scale["days"]) / scale["tau"]
    if days is None:
        return 6 * params * scale["params"] * tokens * scale["tokens"] / (tau * scale["tau"]) / scale["days"]
    spent = tau * scale["tau"] * days * scale["days"] / 6
    if params is None:
        return spent / (tokens * scale["tokens"])
    return spent / (params * scale["params"])


def step_teraflops(weights: Column, batch: Column, length: Column) -> Column:
    return 6.0 * weights * batch * length / 1e12


def learning_rate(step: Column, rate: float, least: float, warmup: int, total: int) -> Column:
    """Linear warm-up from rate / warmup, then a cosine from rate to least."""
    warm = rate * (1 / warmup + (1 - 1 / warmup) * step / warmup)
    cosine = least + (rate - least) * (1 + F.cos(F.lit(math.pi) * (step - warmup) / (total - warmup))) / 2
    return F.when(step < warmup, warm).otherwise(cosine)


def elapsed(seconds: Column) -> Column:
    """h:mm:ss, whole seconds."""
    s = seconds.cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def megabytes_per_second(size: Column, seconds: Column) -> Column:
    return F.try_divide(size / F.lit(float(1 << 20)), seconds)


def log10_or_null(n: Column) -> Column:
    return F.when(n > 0, F.log10(n))


def percent_or_dash(part: Column, whole: Column) -> Column:
    """part / whole as a percentage with one decimal, - where whole is 0."""
    return F.when(whole == 0, F.lit("-")).otherwise(F.format_string("%.1f%%", 100.0 * part / whole))
