"""Numbers: rounding, formats and reading, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column) -> Column:
    """A double to two places by its exact binary value, exact halves to even. The product with 100 is taken with its
    rounding error, which says on which side of a half the value lies."""
    value = F.abs(x)
    big = value * 134217729.0
    high = big - (big - value)
    product = value * 100.0
    error = (high * 100.0 - product) + (value - high) * 100.0
    whole = F.floor(product).cast("double")
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    return F.signum(x) * (whole + F.when(up, 1.0).otherwise(0.0)) / 100.0


def round_half_up(x: Column) -> Column:
    """To a whole number, halves up."""
    return F.floor(x + 0.5).cast("long")


def clamp_percent(x: Column) -> Column:
    """Into 0 to 100; what isn't a finite number is 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)


def compact(x: Column) -> Column:
    """Millions with two places, thousands with none, else the whole number."""
    millions = F.format_string("%.2fM", x / 1e6)
    return F.when(x >= 1e6, millions).when(x >= 1e3, F.format_string("%dK", round_half_up(x / 1e3))).otherwise(F.format_string("%d", round_half_up(x)))


def byte_size(n: Column) -> Column:
    mega = 1024 * 1024
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < mega, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / mega, 1)))


def duration(seconds: Column) -> Column:
    """Whole seconds, halves to even; nothing is 0s."""
    return F.format_string("%ds", F.coalesce(F.rint(seconds), F.lit(0.0)).cast("long"))


def base64_size(n: Column) -> Column:
    """Bytes of n bytes in base64."""
    return F.floor((n + 2) / 3).cast("long") * 4


def last_number(line: Column) -> Column:
    """The last number of a line that isn't 0, without its thousands separators; null without one."""
    found = F.transform(F.regexp_extract_all(line, F.lit(r"[\d,]+\.?\d*"), 0), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(found, lambda n: ~n.isin("", "0", "0.0", "0.00"))), -1)
