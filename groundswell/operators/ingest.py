"""Row validation, quarantine, and what an upload gets back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.functions.columns import scaled_units, units_text


def _not_finite(field: str) -> str:
    return f"NOT abs({field}) < double('Infinity')"  # NaN counts as larger than infinity


# Fixed values: (field, lower bound, upper bound, digits shown), checked in this order.
_BOUNDS = (
    ("depth_m", 0, S.MAX_DEPTH_M, 2),
    ("injection_pressure_kpa", 0, S.MAX_PRESSURE_KPA, 1),
    ("flow_rate_lpm", 0, S.MAX_FLOW_LPM, 1),
    ("surface_uplift_mm", -S.MAX_UPLIFT_MM, S.MAX_UPLIFT_MM, 1),
    ("battery_pct", 0, S.MAX_BATTERY_PCT, 1),
)


def _reason(now: Column) -> Column:
    """Name of the first check that fails, or null."""
    limit = now + F.expr(f"INTERVAL {S.MAX_CLOCK_SKEW_S} SECONDS")
    tests = [
        ("robot_id", F.expr("robot_id = ''")),
        ("site_id", F.expr("site_id = ''")),
        ("ts", F.expr("ts IS NULL OR ts = TIMESTAMP'0001-01-01 00:00:00'")),
        ("future_ts", F.col("ts") > limit),
        ("state", ~F.col("state").isin(*S.STATES)),
        ("finite", F.expr(" OR ".join(_not_finite(f) for f in S.NUMERIC_FIELDS))),
        *[(f, F.expr(f"{f} < {low} OR {f} > {high}")) for f, low, high, _ in _BOUNDS],
    ]
    (name, bad), *rest = tests
    reason = F.when(bad, name)
    for name, bad in rest:
        reason = reason.when(bad, name)
    return reason


def _with_error(df: DataFrame) -> DataFrame:
    """Add the text that goes with `reason`.

    In steps, because a value that is bound to a column once appears once in the
    generated code, and methods beyond 8,000 bytes are not compiled.
    """

    def by_reason(values: list[str]) -> Column:
        cases = zip((f for f, *_ in _BOUNDS), values, strict=True)
        return F.expr("CASE reason " + " ".join(f"WHEN '{f}' THEN {v}" for f, v in cases) + " END")

    spans = [f"'[0, {high}]'" if low == 0 else f"'±{high}'" for _, low, high, _ in _BOUNDS]
    df = df.withColumns(
        {
            "_value": by_reason([f for f, *_ in _BOUNDS]),
            "_places": by_reason([str(places) for *_, places in _BOUNDS]),
            "_span": by_reason(spans),
        }
    )
    df = df.withColumn("_units", scaled_units("_value", F.pow(F.lit(10.0), F.col("_places"))))
    culprit = "CASE " + " ".join(f"WHEN {_not_finite(f)} THEN '{f}'" for f in S.NUMERIC_FIELDS) + " END"
    reason = F.col("reason")
    text = (
        F.when(reason.isin("robot_id", "site_id", "ts"), F.concat(reason, F.lit(" is required")))
        .when(
            reason == "future_ts",
            F.concat(F.lit("ts "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" is more than 5m0s in the future")),
        )
        .when(reason == "state", F.concat(F.lit('unknown state "'), F.regexp_replace("state", r'(["\\])', r"\\$1"), F.lit('"')))
        .when(reason == "finite", F.concat(F.expr(culprit), F.lit(" must be finite")))
        .otherwise(F.concat(reason, F.lit(" "), units_text("_value", "_units", "_places"), F.lit(" outside "), F.col("_span")))
    )
    error = F.concat(F.lit("invalid sample: "), text)
    return df.withColumn("error", error).drop("_value", "_places", "_span", "_units")


def fill_missing(df: DataFrame) -> DataFrame:
    """A missing text is empty and a missing number is zero, as decoders of the wire format have it."""
    return df.fillna("", ["robot_id", "site_id", "state"]).withColumns(
        {f: F.expr(f"coalesce({f}, 0D)") for f in S.NUMERIC_FIELDS}  # fillna would replace NaN, too
    )


def _checked(df: DataFrame, now: Column) -> DataFrame:
    return fill_missing(df).withColumn("reason", _reason(now))


def validate_samples(df: DataFrame, now: Column) -> DataFrame:
    """Add `valid`, and `reason` and `error` (both null for a good row)."""
    return _with_error(_checked(df, now)).withColumn("valid", F.col("reason").isNull())


def accepted_samples(df: DataFrame, now: Column) -> DataFrame:
    return _checked(df, now).where("reason IS NULL").drop("reason")


def rejected_samples(batches: DataFrame, now: Column) -> DataFrame:
    """`batch_id, index, reason, error` of the rows that fail."""
    bad = _checked(batches, now).where("reason IS NOT NULL")
    return _with_error(bad).select("batch_id", "index", "reason", "error")


def batch_response(batches: DataFrame, now: Column) -> DataFrame:
    """Per upload: rows accepted, the rejects with their place, and the status code.

    The list cannot outgrow an upload, which holds at most 5,000 samples.
    """
    bad = F.when(~F.col("valid"), F.struct("index", "error"))
    out = validate_samples(batches, now).groupBy("batch_id").agg(
        F.count_if("valid").alias("accepted"), F.sort_array(F.collect_list(bad)).alias("rejected")
    )
    return out.withColumn("code", F.when(F.col("accepted") > 0, 202).otherwise(422))


def upload_responses(rows: DataFrame, now: Column) -> DataFrame:
    """`batch_response` for `uploaded_rows`; an upload that could not be taken has code 400 and no list."""
    ok = F.col("status") == "ok"
    bad = F.when(ok & ~F.col("valid"), F.struct("index", "error"))
    out = validate_samples(rows, now).groupBy("batch_id", "status").agg(
        F.count_if(ok & F.col("valid")).alias("accepted"), F.sort_array(F.collect_list(bad)).alias("rejected")
    )
    return out.select(
        "batch_id", "accepted", F.when(ok, F.col("rejected")).alias("rejected"),
        F.when(~ok, 400).when(F.col("accepted") > 0, 202).otherwise(422).alias("code"),
    )


def ingest_counters(rows: DataFrame, now: Column) -> DataFrame:
    """`outcome, n` of `uploaded_rows`: accepted rows, rows failing validation, malformed uploads."""
    of_row = F.when(F.col("reason").isNull(), "accepted").otherwise("validation")
    outcome = F.when(F.col("status") == "ok", of_row).otherwise(F.col("status"))
    return _checked(rows.where(F.col("status") != "refused"), now).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
