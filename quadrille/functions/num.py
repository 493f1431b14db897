"""Numbers: rounding half up toward plus infinity, ratios that stay null, nearest-rank quantiles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """``floor(x * 10**digits + 0.5) / 10**digits``: halves go up, also below zero."""
    scale = 10.0**digits
    out = F.floor(x * scale + 0.5).cast("double")
    return out / scale if digits else out


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; null where a side is null or the whole is 0."""
    return F.when(whole != 0, F.floor(part / whole * 1000 + 0.5) / 10)


def per(part: Column, whole: Column, digits: int) -> Column:
    """Quotient with some decimals; null where a side is null or the whole is 0."""
    return F.when(whole != 0, half_up(part / whole, digits))


def nearest_rank(values: Column, share: float) -> Column:
    """Element ``floor(n * share)`` (last at most) of the sorted non-null values; null for none."""
    kept = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(kept)
    return F.when(n > 0, F.element_at(kept, (F.least(n - 1, F.floor(n * F.lit(share))) + 1).cast("int")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def leading_number(text: Column) -> Column:
    """The number a text starts with ("12.5 m" is 12.5); null for none."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def cell_value(raw: Column) -> Column:
    """A statistics cell as struct<value double, suppressed boolean>.

    Blank: null. Withheld marks: null and suppressed. Dash marks: 0. Thousands separators go;
    anything else that is no number is null."""
    # Marks of the published tables.
    withheld = ["X", "x", "秘匿"]
    nought = ["-", "－", "―"]
    text = F.trim(raw)
    number = F.regexp_replace(text, ",", "").try_cast("double")
    value = F.when(text.isin(withheld), F.lit(None).cast("double")).when(text.isin(nought), F.lit(0.0)).otherwise(number)
    return F.struct(value.alias("value"), F.coalesce(text.isin(withheld), F.lit(False)).alias("suppressed"))


def suppressed_sum(cells: list[Column]) -> Column:
    """Sum of struct<value, suppressed> cells: any withheld gives null and suppressed, any missing gives null."""
    withheld = F.lit(False)
    total = F.lit(0.0)
    for cell in cells:
        withheld = withheld | cell["suppressed"]
        total = total + cell["value"]
    return F.struct(F.when(~withheld, total).alias("value"), withheld.alias("suppressed"))
