"""Numbers, dates, lists and nested values."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hours per age unit.
HOURS = {"h": 1, "d": 24, "w": 24 * 7, "mo": 730, "y": 24 * 365}
# How often a pay period fits in a year; hourly pay in dollars gives thousands per year.
PERIODS = {"yr": 1.0, "mo": 12.0, "hr": 2.080}
NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value_map(c: Column | str, table: dict) -> Column:
    """Small lookup; a value that is not in the table gives null."""
    out = reduce(lambda acc, kv: acc.when(_col(c) == F.lit(kv[0]), F.lit(kv[1])), table.items(), F)
    return out if isinstance(out, Column) else F.lit(None)


def to_number(c: Column | str) -> Column:
    """A double, or null when the text is no plain number."""
    return F.when(_col(c).rlike(NUMBER), F.trim(_col(c)).try_cast("double"))


def age_to_hours(c: Column | str) -> Column:
    """``3d`` to 72 hours; an unknown unit gives null."""
    amount = F.regexp_extract(_col(c), r"^(\d*)", 1).try_cast("bigint")
    unit = F.regexp_extract(_col(c), r"(\D*)$", 1)
    return amount * value_map(unit, HOURS).cast("bigint")


def _pay(text: Column, strict_slice: bool) -> Column:
    if strict_slice:
        return to_number(F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0))))
    amount = to_number(F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9.,]*)", 1), ",", ""))
    scale = F.lower(F.regexp_extract(text, r"[0-9.,]+\s*([kKmM])", 1))
    return amount * F.when(scale == "k", 1.0).when(scale == "m", 1000.0).otherwise(0.001)


def salary_bounds(c: Column | str, strict_slice: bool = True) -> Column:
    """Struct (lower, upper) of a pay text such as ``$100k-$150k/yr``, in thousands per year.

    ``strict_slice`` cuts one character off both ends of each bound, so it fits amounts written
    ``$100k``; hourly dollars then lose a digit and weekly pay counts as zero. Without it the number
    and its k / m suffix are read by pattern and weeks count 52 times.
    """
    pieces = F.split(_col(c), "/")
    period = F.get(pieces, F.lit(1))
    bounds = F.split(F.get(pieces, F.lit(0)), "-")
    if strict_slice:
        times = F.coalesce(value_map(period, PERIODS), F.lit(0.0))
    else:
        times = value_map(period, {**PERIODS, "hr": 2080.0, "wk": 52.0})
    return F.struct(
        (_pay(F.get(bounds, F.lit(0)), strict_slice) * times).alias("lower"),
        (_pay(F.try_element_at(bounds, F.lit(-1)), strict_slice) * times).alias("upper"),
    )


def midpoint(lower: Column | str, upper: Column | str) -> Column:
    return (_col(lower) + _col(upper)) / F.lit(2)


def leading_number(c: Column | str) -> Column:
    """The number before the first ``+``."""
    return to_number(F.substring_index(_col(c), "+", 1))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers that arrive as NaN become null, so that sorts and counts treat them as missing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def date_prefix(c: Column | str) -> Column:
    """Date from the first ten characters, null when they are no date."""
    return F.try_to_date(F.substring(_col(c), 1, 10), "yyyy-MM-dd")


def floor_seconds(epoch: Column | str) -> Column:
    return F.date_trunc("second", F.timestamp_seconds(_col(epoch)))


def to_utc(c: Column | str) -> Column:
    """A time without zone read as UTC, whatever the zone of the session."""
    span = _col(c).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), span).cast("bigint")
    minutes = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return F.timestamp_micros(minutes * 60_000_000 + (F.extract(F.lit("SECOND"), span) * 1_000_000).cast("bigint"))


def whole_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days between two times of one type. No zone enters, so no clock change does."""
    return F.extract(F.lit("DAY"), end - start).cast("bigint")


def recency_weight(published: Column | str, newest: Column, per_day: float = 0.01) -> Column:
    """1 for the newest posting, less per whole day of age, never below 0."""
    days = whole_days(_col(published), newest)
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(per_day) * days)


def list_or_empty(c: Column | str, element: str = "string") -> Column:
    return F.coalesce(_col(c), F.array().cast(f"array<{element}>"))


def is_list(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def as_list(df: DataFrame, name: str) -> Column:
    """A text column as a list of one, a list column as it is: chosen from the schema at plan time."""
    return F.col(name) if is_list(df, name) else F.when(F.col(name).isNotNull(), F.array(name))


def as_text(df: DataFrame, name: str, separator: str = "; ") -> Column:
    return F.array_join(name, separator) if is_list(df, name) else F.col(name)


def zip_pairs(left: Column | str, right: Column | str) -> Column:
    """Two parallel lists as one list of (a, b)."""
    return F.zip_with(_col(left), _col(right), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def format_location(loc: Column) -> Column:
    """``name - radius unit. type | type`` of a saved-search location; no radius part without options."""
    name = F.replace(F.get(loc["address_components"], F.lit(0))["long_name"], F.lit("+"), F.lit(" "))
    options = loc["options"]
    radius = F.when(
        options["radius"].isNotNull(),
        F.concat(F.lit(" - "), options["radius"].cast("string"), F.lit(" "), options["radius_unit"]),
    ).otherwise(F.lit(""))
    return F.concat(name, radius, F.lit(". "), F.array_join(loc["workplace_types"], " | "))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once per row, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


#: elements summed in one go by ``sums_before``
STRETCH = 128


def sums_before(sizes: Column) -> Column:
    """For every element of a list of numbers the sum of those ahead of it.

    Sums of stretches first, then within a stretch: a list of n numbers costs n * STRETCH steps, not n * n.
    """
    def of(c: Column) -> Column:
        add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
        starts = F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0)), F.lit(STRETCH))
        pieces = F.transform(starts, lambda at: add(F.slice(c, at + 1, STRETCH)))
        ahead = lambda ps: F.transform(ps, lambda _, k: add(F.slice(ps, 1, k)))
        within = lambda hs: F.transform(
            c, lambda _, i: F.get(hs, F.floor(i / STRETCH).cast("int")) + add(F.slice(c, (F.floor(i / STRETCH) * STRETCH + 1).cast("int"), i % STRETCH))
        )
        return bound(pieces, lambda ps: bound(ahead(ps), within))

    return bound(sizes, of)
