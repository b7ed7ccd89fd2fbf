"""Preference, reward, divergence and schedule arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def must(cond: Column, x: Column, message: str, kind: str = "double") -> Column:
    return F.when(cond, x).otherwise(F.raise_error(F.lit(message)).cast(kind))


def neg_log_sigmoid(d: Column) -> Column:
    """-log of the logistic function, stable on both sides; a value that isn't finite raises."""
    return must(finite(d), F.when(d >= 0, F.log1p(F.exp(-F.abs(d)))).otherwise(-d + F.log1p(F.exp(-F.abs(d)))), "margin is not finite")


def preference_delta(beta: float, chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column) -> Column:
    return F.lit(beta) * ((chosen - rejected) - (ref_chosen - ref_rejected))


def reward(cer: Column, empty: Column, repeated: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """1 - CER, less a half each for empty and repeated output, clipped."""
    raw = 1 - cer - 0.5 * empty.cast("int") - 0.5 * repeated.cast("int")
    return F.greatest(F.lit(low), F.least(F.lit(high), raw))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.try_divide(total(xs), F.size(xs))


def k3(policy: Column, reference: Column) -> Column:
    """Mean over tokens of expm1(d) - d with d = reference - policy."""
    return mean(F.zip_with(policy, reference, lambda p, r: F.expm1(r - p) - (r - p)))


def exact_kl(policy: Column, reference: Column) -> Column:
    """Mean over positions of the divergence of two log-probability rows, none below 0."""
    row = lambda p, r: F.greatest(F.lit(0.0), total(F.zip_with(p, r, lambda a, b: F.exp(a) * (a - b))))
    return mean(F.zip_with(policy, reference, row))


def sequence_logprob(nll: Column) -> Column:
    """Minus the sum of token costs; none or one that isn't finite raises."""
    return must((F.size(nll) > 0) & F.forall(nll, finite), -total(nll), "token costs are empty or not finite")


def lr_multiplier(step: Column, warmup: int, steps: int, least: float = 0.0) -> Column:
    """Of a completed step: linear warm-up, then a half cosine down to `least`."""
    if warmup < 0 or steps <= warmup:
        raise ValueError("the schedule ends before its warm-up")
    done = (step - warmup) / float(steps - warmup)
    half = F.lit(least) + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * done))
    return F.when(step <= 0, 0.0).when(F.lit(warmup > 0) & (step <= warmup), step / float(max(1, warmup))).when(step >= steps, F.lit(least)).otherwise(half)


def matches_within(a: Column, b: Column, absolute: float = 1e-4, relative: float = 1e-5) -> Column:
    """struct(abs_error, rel_error, ok): ok needs both tolerances."""
    err = F.abs(a - b)
    rel = F.coalesce(F.try_divide(err, F.greatest(F.abs(a), F.abs(b))), F.lit(0.0))
    return F.struct(err.alias("abs_error"), rel.alias("rel_error"), ((err <= absolute) & (rel <= relative)).alias("ok"))


def duration_ms(seconds: Column) -> Column:
    """Milliseconds, halves to even; null for what isn't a finite number."""
    return F.when(finite(seconds), F.rint(seconds * 1000).cast("long"))


def over_budget(elapsed_s: Column, most_minutes: float, margin_minutes: float) -> Column:
    return elapsed_s > (most_minutes - margin_minutes) * 60


def evaluation_due(step: Column, every: int, last: int) -> Column:
    """A step to evaluate at: a multiple of the interval, or the end of the schedule."""
    return (step > 0) & ((step % every == 0) | (step >= last))
