"""Rates, histograms and quantiles of the service itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.functions.columns import time_bin


def windowed_rate(df: DataFrame, at: str, by: Sequence[str] = (), window_s: int = 60, step_s: int = 5) -> DataFrame:
    """Events per second over the trailing `window_s`, at every step where there are any.

    Events are counted per step before a count is copied into the windows it is
    part of.  These are exact counts; nothing is extrapolated to the window's ends.
    """
    steps = df.groupBy(*by, time_bin(at, step_s).alias("_step")).agg(F.count("*").alias("_n"))
    offsets = F.sequence(F.lit(1), F.lit(window_s // step_s))
    ends = F.timestamp_micros(F.unix_micros("_step") + F.col("_k") * F.lit(step_s * 1_000_000).cast("long"))
    return (
        steps.select("*", F.explode(offsets).alias("_k"))
        .groupBy(*by, ends.alias("window_end"))
        .agg((F.sum("_n") / F.lit(float(window_s))).alias("rate"))
    )


def _counts(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """One row per group: cumulative counts `n0, n1, …` up to each bound, and `total`."""
    counts = [F.count_if(F.col(value) <= b).alias(f"n{i}") for i, b in enumerate(bounds)]
    return df.groupBy(*by).agg(*counts, F.count(value).alias("total"))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts `le, n` per group; the last bound is infinity."""
    columns = [*((b, f"n{i}") for i, b in enumerate(bounds)), (float("inf"), "total")]
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(c).alias("n")) for b, c in columns]
    return _counts(df, value, bounds, by).select(*by, F.inline(F.array(*pairs)))


def histogram_quantile(df: DataFrame, value: str, bounds: Sequence[float], q: float, by: Sequence[str]) -> DataFrame:
    """Quantile as a histogram tells it: linear inside the first bucket that reaches the rank.

    The lowest bucket starts at 0; a rank beyond the last finite bound gives that
    bound.  The counts of a group sit in one row, so one aggregation is all it takes.
    """
    rank = F.col("total") * F.lit(q)
    low, below = 0.0, F.lit(0)
    result = F.when(F.lit(False), F.lit(0.0))
    for i, bound in enumerate(bounds):
        n = F.col(f"n{i}")
        inside = F.lit(low) + F.lit(float(bound) - low) * (rank - below) / (n - below)
        result = result.when(n >= rank, F.when(n == below, F.lit(low)).otherwise(inside))
        low, below = float(bound), n
    counts = _counts(df, value, bounds, by).where("total > 0")
    return counts.select(*by, result.otherwise(F.lit(low)).alias("value"))


def batch_size_histogram(status: DataFrame) -> DataFrame:
    """Sizes of the uploads that passed the size gate."""
    return histogram(status.where(F.col("status") == "ok"), "samples", S.BATCH_SIZE_BOUNDS)


def latency_histogram(requests: DataFrame) -> DataFrame:
    return histogram(requests, "duration_s", S.LATENCY_BOUNDS, ["route", "code"])


def p95_latency(requests: DataFrame, window_s: int = 300) -> DataFrame:
    """95th percentile per route and `window_s` window; status codes are summed away."""
    windowed = requests.withColumn("window_start", time_bin("at", window_s))
    by = ["route", "window_start"]
    return histogram_quantile(windowed, "duration_s", S.LATENCY_BOUNDS, 0.95, by)

