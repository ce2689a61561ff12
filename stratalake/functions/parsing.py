"""Column expressions for tokens, numbers, angles, units and ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Parts of one million by unit of mass fraction.
MASS_PPM = {"ppb": 0.001, "ppm": 1.0, "gpt": 1.0, "g/t": 1.0, "%": 10000.0, "wt%": 10000.0, "pct": 10000.0}
FOOT = 0.3048


def number(raw: Column) -> Column:
    """A finite decimal number, else null. Underscores, suffixes, NaN and infinities are none."""
    text = F.trim(raw)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def token(raw: Column, missing: list[str], states: dict[str, str]) -> Column:
    """STRUCT<state, value, limit> of a laboratory token: declared states first, then missing, limits, numbers."""
    text = F.trim(raw)
    limit = number(F.substring(text, 2, 1 << 30))
    positive = limit.isNotNull() & (limit > 0)

    def row(state: str | Column, value: Column | None = None, bound: Column | None = None) -> Column:
        return F.struct((F.lit(state) if isinstance(state, str) else state).alias("state"), (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(None) if bound is None else bound).cast("double").alias("limit"))

    out = F.when(raw.isNull() | text.isin(missing) | (text == ""), row("missing"))
    for spelled, state in states.items():
        out = out.when(text == spelled, row(state))
    return out.when(text.startswith("<") & positive, row("below-limit", bound=limit)).when(text.startswith(">") & positive, row("above-limit", bound=limit)).when(number(raw).isNotNull(), row("measured", value=number(raw))).otherwise(row("undeclared"))


def wrapped_azimuth(azimuth: Column) -> Column:
    return F.pmod(azimuth, F.lit(360.0)) + F.lit(0.0)  # no negative zero


def dip_below_horizontal(dip: Column, convention: str) -> Column:
    """Dips with down negative, from down-positive, from-vertical or down-negative readings."""
    return {"down-positive": 0.0 - dip, "from-vertical": dip - 90, "down-negative": dip}[convention]


def metres(value: Column, unit: Column) -> Column:
    return F.when(unit == "ft", value * FOOT).when(unit == "m", value)


def parts_per_million(value: Column, unit: Column) -> Column:
    """Mass fractions in ppm; an unknown unit gives null."""
    out = F.lit(None).cast("double")
    for name, factor in MASS_PPM.items():
        out = F.when(unit == name, value * F.lit(factor)).otherwise(out)
    return out


def plain_id(raw: Column) -> Column:
    """Letters and digits only, upper case, leading zeros of digit runs dropped."""
    return F.regexp_replace(F.upper(F.regexp_replace(raw, "[^0-9A-Za-z]", "")), "(?<![0-9])0+(?=[0-9])", "")


def hole_key(namespace: Column, source_id: Column) -> Column:
    return F.concat(namespace, F.lit(":"), source_id)


def support_kind(from_md: Column, to_md: Column, parts: Column) -> Column:
    return F.when(from_md.isNull() | to_md.isNull(), "unknown").when(parts > 1, "sampling-envelope").when(from_md == to_md, "point").otherwise("interval")


def direction(azimuth: Column, dip: Column) -> tuple[Column, Column, Column]:
    """East, north and up cosines; dip negative down."""
    a, d = F.radians(azimuth), F.radians(dip)
    return F.sin(a) * F.cos(d), F.cos(a) * F.cos(d), F.sin(d)


def wendland(r: Column) -> Column:
    return F.pow(F.greatest(1 - r, F.lit(0.0)), 6) * (35 * r * r + 18 * r + 3) / 3


def half_even(value: Column, scale: int) -> Column:
    return F.bround(value, scale)


def grid_cell(value: Column, origin: float, cell: float) -> Column:
    return F.floor((value - origin) / cell)
