"""Waveform functions: mono and resampling, degradations, slices with quality limits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructType

RATE = 16_000


def mono_16k(samples: np.ndarray, rate: int) -> np.ndarray:
    """Mean of the channels, clipped, linearly resampled to 16 kHz; nothing to resample raises."""
    x = np.asarray(samples, np.float32)
    x = np.clip(x.mean(axis=1) if x.ndim > 1 else x, -1, 1)
    if rate == RATE:
        return x
    if rate <= 0 or not len(x):
        raise ValueError("no samples or no rate")
    n = round(len(x) * RATE / rate)
    return np.interp(np.arange(n) / n, np.arange(len(x)) / len(x), x).astype(np.float32)


def limited(x: np.ndarray) -> np.ndarray:
    peak = np.abs(x).max(initial=0)
    return np.clip(x / np.float32(peak) if peak > 1 else x, -1, 1).astype(np.float32)


def noise(x: np.ndarray, snr_db: float, seed: int) -> np.ndarray:
    """White noise at a signal-to-noise ratio, the same for the same seed; silence raises."""
    power = float(np.mean(np.square(x)))
    if power <= 0:
        raise ValueError("silent waveform")
    hiss = np.random.default_rng(seed).normal(0.0, 1.0, size=x.shape).astype(np.float32)
    gain = np.sqrt(power / (float(np.mean(np.square(hiss))) * 10.0 ** (snr_db / 10)))
    return np.clip(x + hiss * np.float32(gain), -1, 1)


def reverb(x: np.ndarray, delay_ms: float, decay: float, repeats: int) -> np.ndarray:
    """The waveform and its decaying echoes at multiples of a delay."""
    out, delay = x.astype(np.float32), max(1, round(RATE * delay_ms / 1000))
    for k in range(1, repeats + 1):
        if k * delay < len(x):
            out[k * delay :] += x[: len(x) - k * delay] * np.float32(decay**k)
    return limited(out)


def far_field(x: np.ndarray, window: int, gain: float) -> np.ndarray:
    """A moving average, attenuated."""
    return limited(np.convolve(x, np.full(window, 1 / np.float32(window), np.float32), mode="same").astype(np.float32) * np.float32(gain))


def dropout(x: np.ndarray, start_ratio: float, width_ratio: float) -> np.ndarray:
    """One span inside the waveform set to zero, at least one sample."""
    a = int(len(x) * start_ratio)
    b = min(len(x), max(a + 1, int(len(x) * (start_ratio + width_ratio))))
    out = x.astype(np.float32)
    out[a:b] = 0
    return out


def render(sources: DataFrame, settings: dict[str, dict], seed: int) -> DataFrame:
    """`sources(source_id, samples)` as rows (source_id, scenario, samples, reason), one a scenario.

    A scenario that can't be rendered has a reason instead of samples.
    """
    from quillstone.functions.hashing import scenario_seed
    from quillstone.functions.text import SCENARIOS

    rows = sources.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in SCENARIOS])))
    rows = rows.withColumn("seed", scenario_seed(seed, F.col("source_id"), F.col("scenario")))

    def one(x: np.ndarray, scenario: str, s: int) -> np.ndarray:
        o = settings.get(scenario, {})
        if scenario == "noise":
            return noise(x, o["snr_db"], s)
        if scenario == "reverb":
            return reverb(x, o["delay_ms"], o["decay"], o["repeats"])
        if scenario == "far_field":
            return far_field(x, o["lowpass_window"], o["gain"])
        return dropout(x, o["start_ratio"], o["width_ratio"]) if scenario == "dropout" else x

    def each(batches):
        for pdf in batches:
            made, why = [], []
            for x, scenario, s in zip(pdf["samples"], pdf["scenario"], pdf["seed"]):
                try:
                    made.append(one(np.asarray(x, np.float32), scenario, int(s)))
                    why.append(None)
                except ValueError as e:
                    made.append(None)
                    why.append(str(e))
            yield pd.DataFrame({"source_id": pdf["source_id"], "scenario": pdf["scenario"], "samples": made, "reason": why})

    schema = StructType().add("source_id", StringType()).add("scenario", StringType()).add("samples", ArrayType(FloatType())).add("reason", StringType())
    return rows.select("source_id", "scenario", "seed", "samples").mapInPandas(each, schema)


def slice_by_time(samples: Column, xmin: Column, xmax: Column, rate: int = RATE) -> Column:
    """Samples of an interval, times rounded to frames, halves to even."""
    a, b = F.rint(xmin * rate).cast("int"), F.rint(xmax * rate).cast("int")
    return F.slice(samples, a + 1, F.greatest(F.least(b, F.size(samples)) - a, F.lit(0)))


def quality_problem(samples: Column, least_peak: float, least_rms: float) -> Column:
    """empty, not_finite, low_peak or low_rms, else null; JVM-side."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    rms = F.sqrt(F.try_divide(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), F.size(samples)))
    bad = F.exists(samples, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.size(samples) <= 0, "empty").when(bad, "not_finite").when(peak < least_peak, "low_peak").when(rms < least_rms, "low_rms")
