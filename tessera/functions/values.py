"""Value helpers of the verb layer: recoding, comparison and row-wise aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_in(value: Column, members: list) -> Column:
    """Set membership; a null is in no set, so the negation keeps it."""
    return F.coalesce(value.isin(*members), F.lit(False)) if members else F.lit(False)


def when_any(*conditions: Column) -> Column:
    """OR of all; of none it is false."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def when_all(*conditions: Column) -> Column:
    """AND of all; of none it is true."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def if_any(df: DataFrame, names: list[str], test) -> Column:
    return when_any(*(test(F.col(n)) for n in names))


def if_all(df: DataFrame, names: list[str], test) -> Column:
    return when_all(*(test(F.col(n)) for n in names))


def case_when(*branches: tuple[Column, object], default: object = None) -> Column:
    """First true branch; without one the default."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    if not branches:
        return as_column(default)
    chain = F
    for test, value in branches:
        chain = chain.when(test, as_column(value))
    return chain.otherwise(as_column(default))


def recode_values(value: Column, table: dict, default: object = None, unmatched: str = "default") -> Column:
    """Looks a value up; ``unmatched='error'`` stops the job on a non-null value without an entry."""
    found = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value) if table else F.lit(None)
    known = is_in(value, list(table))
    if unmatched == "error":
        return F.when(known, found).when(value.isNull(), found).otherwise(F.raise_error(F.concat(F.lit("no value for "), value.cast("string"))))
    return F.when(known, found).otherwise(default if isinstance(default, Column) else F.lit(default))


def replace_values(value: Column, table: dict) -> Column:
    """Looks a value up; one without an entry stays."""
    return recode_values(value, table, default=value)


def replace_when(value: Column, *branches: tuple[Column, object]) -> Column:
    return case_when(*branches, default=value)


def if_else(test: Column, yes: object, no: object, missing: object = None) -> Column:
    return case_when((test, yes), (~test, no), default=missing)


def na_if(value: Column, other: object) -> Column:
    return F.nullif(value, other if isinstance(other, Column) else F.lit(other))


def near(a: Column, b: Column, tolerance: float = 1.490116e-08) -> Column:
    return F.abs(a - b) < tolerance


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def half_even(value: Column, digits: int) -> Column:
    """Rounding of halves to the even digit."""
    return F.bround(value, digits)


def row_mean(*columns: Column) -> Column:
    return sum(columns[1:], columns[0]) / len(columns)


def row_max(*columns: Column) -> Column:
    return F.greatest(*columns)


def row_min(*columns: Column) -> Column:
    return F.least(*columns)


def excludes_zero(lower: Column, upper: Column) -> Column:
    return (lower > 0) | (upper < 0)


def extract_numeric(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9.-]+", "").try_cast("double")


def parse_time(text: Column, *formats: str) -> Column:
    """A time by the first of some formats that fits; null where none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def parse_date(text: Column, *formats: str) -> Column:
    return parse_time(text, *formats).cast("date")


def comma(number: Column, digits: int = 0) -> Column:
    """A number with commas between thousands."""
    return F.format_number(number, digits)


def percent(share: Column, digits: int = 0) -> Column:
    """A share as a percentage."""
    return F.concat(F.format_number(100 * share, digits), F.lit("%"))
