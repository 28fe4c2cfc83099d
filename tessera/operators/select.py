"""Column selection by rule, resolved on the driver against the schema (never against data)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rule = Callable[[DataFrame], list[str]]


def _rule(test: Callable[[str], bool]) -> Rule:
    return lambda df: [c for c in df.columns if test(c)]


def starts_with(*prefixes: str) -> Rule:
    return _rule(lambda c: c.lower().startswith(tuple(p.lower() for p in prefixes)))


def ends_with(*suffixes: str) -> Rule:
    return _rule(lambda c: c.lower().endswith(tuple(s.lower() for s in suffixes)))


def contains(*parts: str) -> Rule:
    return _rule(lambda c: any(p.lower() in c.lower() for p in parts))


def matches(pattern: str) -> Rule:
    return _rule(lambda c: re.search(pattern, c, re.I) is not None)


def num_range(prefix: str, numbers, width: int = 0) -> Rule:
    names = [f"{prefix}{n:0{width}d}" for n in numbers]
    return lambda df: [c for c in names if c in df.columns]


def where(test: Callable[[T.DataType], bool]) -> Rule:
    return lambda df: [f.name for f in df.schema if test(f.dataType)]


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def everything() -> Rule:
    return lambda df: list(df.columns)


def last_col(offset: int = 0) -> Rule:
    return lambda df: [df.columns[-1 - offset]]


def all_of(names: list[str]) -> Rule:
    """These columns; a missing one is an error."""

    def run(df: DataFrame) -> list[str]:
        if missing := [n for n in names if n not in df.columns]:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        return list(names)

    return run


def any_of(names: list[str]) -> Rule:
    return lambda df: [n for n in names if n in df.columns]


def span(first: str, last: str) -> Rule:
    """The columns from one to another, in the table's order."""
    return lambda df: df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def both(a: Rule, b: Rule) -> Rule:
    return lambda df: [c for c in a(df) if c in b(df)]


def either(a: Rule, b: Rule) -> Rule:
    return lambda df: list(dict.fromkeys([*a(df), *b(df)]))


def exclude(a: Rule) -> Rule:
    return lambda df: [c for c in df.columns if c not in a(df)]


def resolve(df: DataFrame, *rules: Rule | str) -> list[str]:
    """Distinct column names of rules and names, in the order asked for."""
    out: list[str] = []
    for rule in rules:
        out += all_of([rule])(df) if isinstance(rule, str) else rule(df)
    return list(dict.fromkeys(out))


def select(df: DataFrame, *rules: Rule | str, **renamed: str) -> DataFrame:
    """Chosen columns; ``new='old'`` chooses and renames."""
    return df.select(*resolve(df, *rules), *(F.col(old).alias(new) for new, old in renamed.items()))


def rename(df: DataFrame, **names: str) -> DataFrame:
    """``new='old'``; every old column must exist."""
    all_of(list(names.values()))(df)
    return df.withColumnsRenamed({old: new for new, old in names.items()})


def rename_present(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Renames those aliases that exist; for outputs whose column names vary by version."""
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns})


def rename_with(df: DataFrame, change: Callable[[str], str], *rules: Rule | str) -> DataFrame:
    chosen = resolve(df, *rules) if rules else df.columns
    return df.withColumnsRenamed({c: change(c) for c in chosen})


def relocate(df: DataFrame, *rules: Rule | str, before: str | None = None, after: str | None = None) -> DataFrame:
    moved = resolve(df, *rules)
    rest = [c for c in df.columns if c not in moved]
    at = rest.index(before) if before else rest.index(after) + 1 if after else 0
    return df.select(*rest[:at], *moved, *rest[at:])


def require(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself, or an error that lists the missing columns."""
    all_of(names)(df)
    return df


def across(df: DataFrame, rules: list, functions: dict[str, Callable], names: str = "{col}_{fn}", keys: tuple[str, ...] = ()) -> list:
    """Columns of every function over every chosen column but the keys."""
    return [fn(F.col(c)).alias(names.format(col=c, fn=n)) for c in resolve(df, *rules) if c not in keys for n, fn in functions.items()]


def pick(df: DataFrame, *rules: Rule | str) -> list[Column]:
    """The chosen columns, for ``groupBy``, ``select`` or as fields of a struct."""
    return [F.col(f"`{c}`") for c in resolve(df, *rules)]


def c_across(df: DataFrame, *rules: Rule | str) -> Column:
    """The chosen columns of a row as one array, to be summed up row by row."""
    return F.array(*pick(df, *rules))
