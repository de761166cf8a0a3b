"""Column functions for loosely typed answers: numbers, dates, labels, decimal tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
MISSING = ("", "nan", "none", "null")
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_INFINITE = r"(?i)^[+-]?(inf|infinity)$"


def is_finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x)


def norm(x: Column, missing: str = "none") -> Column:
    """Trimmed lower-case text; null gives the text for missing."""
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit(missing))))


def safe_double(x: Column) -> Column:
    """Number in a text; null for missing texts, words and what is not finite."""
    t = F.trim(x.cast("string"))
    return F.when(t.rlike(_NUMBER), finite_or_null(t.try_cast("double")))


def scored_double(x: Column) -> Column:
    """As safe_double, but texts of infinity give infinity."""
    t = F.trim(x.cast("string"))
    return F.when(t.rlike(_INFINITE), F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(safe_double(x))


def millimetres(x: Column) -> Column:
    """Number with an optional unit (mm or its CJK words) and thousands separators."""
    return safe_double(F.regexp_replace(F.regexp_replace(F.lower(x.cast("string")), "mm|毫米|公厘", ""), "[,，]", ""))


def strict_bool(x: Column) -> Column:
    """true/1/yes/y and false/0/no/n; anything else is null."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def is_none(x: Column) -> Column:
    """Null or a text that stands for none."""
    return x.isNull() | norm(x).isin(*MISSING)


def parse_date(x: Column, policy: str = "any") -> Column:
    """A date by policy; null if it fits none.

    score: eight digits or ten-character ISO. any: also dots and slashes.
    first10: ISO in the first ten characters. gate: dots, underscores and slashes as dashes, or eight digits.
    """
    t = F.trim(x.cast("string"))
    day = lambda text, form, shape: F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)).cast("date"))
    iso = lambda text: day(text, "yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$")
    digits = lambda text: day(text, "yyyyMMdd", r"^\d{8}$")
    if policy == "score":
        return F.coalesce(digits(t), iso(t))
    if policy == "first10":
        return iso(F.substring(t, 1, 10))
    if policy == "gate":
        return F.coalesce(digits(t), iso(F.translate(t, "._/", "---")))
    if policy == "any":
        return F.coalesce(iso(t), digits(t), iso(F.translate(t, "./", "--")), iso(F.substring(t, 1, 10)))
    raise ValueError(f"unknown policy {policy}")


def yyyymmdd(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def decimal(x: Column) -> Column:
    """Exact decimal of a number's text, to 18 places."""
    return F.when(F.trim(x.cast("string")).rlike(_NUMBER), F.trim(x.cast("string")).try_cast("decimal(38,18)"))


def within_tolerance(prediction: Column, target: Column, tolerance: Column) -> Column:
    """|prediction - target| <= tolerance, inclusive, in decimal arithmetic; what is no finite number, and a negative tolerance, is false."""
    p, g, t = decimal(prediction), decimal(target), decimal(tolerance)
    return F.coalesce((t >= 0) & (F.abs(p - g) <= t), F.lit(False))


def one_decimal(x: Column) -> Column:
    """Rounded half up to one place, never minus zero.

    Tenths are rounded as SQL engines do: the double ten times as large, not the number's decimal
    text, which puts a difference one bit below a half (56.85 = 94.873 - 38.023) on the other side.
    """
    return F.round(x * F.lit(10.0), 0) / F.lit(10.0) + F.lit(0.0)


def round_to(x: Column, step: float) -> Column:
    """Nearest multiple of step, halves to even."""
    return F.bround(x / F.lit(float(step)), 0) * F.lit(float(step))


def base_key(example_id: Column, task: Column) -> Column:
    """An example's series: its id without the task at its end."""
    tail = F.concat(F.lit("_"), task)
    return F.when(F.endswith(example_id, tail), F.left(example_id, F.length(example_id) - F.length(tail))).otherwise(example_id)
