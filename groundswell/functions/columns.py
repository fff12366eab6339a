"""Column builders: everything here stays inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundswell import schema as S

MICROS = 1_000_000


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def time_bin(ts: Column | str, seconds: float) -> Column:
    """Floor a timestamp to a bucket counted from 2000-01-01T00:00:00Z."""
    micros = F.unix_micros(_c(ts))
    width = F.lit(int(round(seconds * MICROS))).cast("long")
    origin = F.lit(S.BIN_ORIGIN_S * MICROS).cast("long")
    return F.timestamp_micros(micros - F.pmod(micros - origin, width))


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / F.lit(60.0 * MICROS)


def cell(coord: Column | str) -> Column:
    """Index of the 1 m cell; halves go towards positive infinity."""
    return F.floor(_c(coord) + F.lit(0.5)).cast("long")


def round_half_away(col: Column | str, places: int) -> Column:
    """Binary rounding, halves away from zero (not through decimal text as `round` does)."""
    scale = F.lit(float(10**places))
    return F.signum(_c(col)) * F.floor(F.abs(_c(col)) * scale + F.lit(0.5)) / scale


def mogi_uplift_m(volume_m3: Column, depth_m: Column, r2: Column) -> Column:
    """Surface lift in metres of a point source, `r2` being the squared distance."""
    slant2 = r2 + depth_m * depth_m
    lift = F.lit(1.0 - S.POISSON) * volume_m3 / F.pi() * depth_m / (slant2 * F.sqrt(slant2))
    return F.when((depth_m <= 0) | (volume_m3 == 0), F.lit(0.0)).otherwise(lift)


def expected_pressure_kpa(depth_m: Column | str, flow_lpm: Column | str, filled: Column | str) -> Column:
    """Pressure the model expects at a depth, a flow and a filled fraction."""
    share = F.least(F.greatest(_c(filled), F.lit(0.0)), F.lit(1.0))
    breakdown = F.lit(S.OVERBURDEN_KPA_PER_M) * _c(depth_m) * F.lit(S.BREAKDOWN_FACTOR)
    resistance = F.lit(S.RESISTANCE_KPA_PER_LPM) * _c(flow_lpm) * (F.lit(1.0) + share * share)
    return F.when(_c(flow_lpm) <= 0, F.lit(0.0)).otherwise(breakdown + resistance)


def ramp_index(t: Column | str) -> Column:
    """Position of `t` in [0, 1] on the colour ramp, clamped at both ends."""
    share = F.least(F.greatest(_c(t), F.lit(0.0)), F.lit(1.0))
    return F.floor(share * F.lit(float(len(S.RAMP) - 1)) + F.lit(0.5)).cast("int")


def ramp_colour(t: Column | str, dark: bool = False) -> Column:
    colours = S.RAMP[::-1] if dark else S.RAMP
    return F.element_at(F.array(*[F.lit(c) for c in colours]), ramp_index(t) + F.lit(1))


RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}([.,]\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_rfc3339(text: Column | str) -> Column:
    """Strict RFC 3339; anything else gives null.  Digits below a microsecond are cut."""
    text = _c(text)
    cut = F.regexp_replace(F.upper(text), r"[.,](\d{1,6})\d*", ".$1")
    return F.when(text.rlike(RFC3339), cut.try_cast("timestamp"))


def format_rfc3339(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def truncate_ms(ts: Column | str) -> Column:
    return F.timestamp_millis(F.unix_millis(_c(ts)))


def scaled_units(value: Column | str, scale: Column | str) -> Column:
    """`|value| * scale` as a whole number, rounded from the exact binary value (ties to even).

    The product alone would round 0.35 * 10 up to 3.5.  The value is split in two, so
    that the error of the product is known and decides when the product sits on a tie.
    """
    v, scale = F.abs(_c(value)), _c(scale).cast("double")
    product = v * scale
    whole = F.floor(product)
    split = v * F.lit(134217729.0)
    high = split - (split - v)
    error = (high * scale - product) + (v - high) * scale
    above = product - whole
    up = (above > 0.5) | ((above == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    return whole + up.cast("long")


def units_text(value: Column | str, units: Column | str, places: Column | str) -> Column:
    """`value` with `places` digits; `units` comes from `scaled_units`."""
    value, units, places = _c(value), _c(units), _c(places)
    base = F.pow(F.lit(10.0), places).cast("long")
    digits = F.lpad((units % base).cast("string"), places, F.lit("0"))
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.floor(units / base).cast("string"), F.lit("."), digits)
    return F.when(F.abs(value) < 9e13, text).otherwise(F.format_string("%.1f", value))


_DURATION_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_DURATION_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)")


def duration_seconds(text: str) -> float:
    """`"1m"`, `"1h30m"`, `"250ms"` → seconds; raises ValueError on anything else."""
    sign, body = (-1.0, text[1:]) if text.startswith("-") else (1.0, text.removeprefix("+"))
    if body == "0":
        return 0.0
    parts = _DURATION_PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"invalid duration {text!r}")
    return sign * sum(float(n) * _DURATION_UNITS[u] for n, u in parts)
