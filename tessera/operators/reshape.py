"""Pivoting, nesting, rectangling, separating and completing tables.

Pivots take their values as an argument (the domain is known or asked for once), so no job runs to
find them, and cells are made by partial aggregation.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.operators.verbs import join_groups


def pivot_longer(df: DataFrame, columns: list[str], names_to: str = "name", values_to: str = "value", prefix: str = "", drop_na: bool = False) -> DataFrame:
    ids = [c for c in df.columns if c not in columns]
    out = df.unpivot(ids, columns, names_to, values_to)
    if prefix:
        out = out.withColumn(names_to, F.regexp_replace(names_to, f"^{re.escape(prefix)}", ""))
    return out.where(F.col(values_to).isNotNull()) if drop_na else out


def pivot_longer_pattern(df: DataFrame, columns: list[str], pattern: str, names_to: list[str], values_to: str = "value") -> DataFrame:
    """Column names in parts: the groups of ``pattern`` go to ``names_to``; the part named ``.value``
    keeps its own column of values."""
    return pivot_longer_spec(df, longer_spec(columns, pattern, names_to, values_to))


def pivot_wider(df: DataFrame, ids: list[str], names_from: str, domain: list, value: Column, fill: object = None, prefix: str = "") -> DataFrame:
    """One column a value of the domain; ``value`` is an aggregate over the rows of a cell."""
    out = df.groupBy(*ids).pivot(names_from, domain).agg(value)
    named = [F.col(f"`{d}`").alias(f"{prefix}{d}") if fill is None else F.coalesce(F.col(f"`{d}`"), F.lit(fill)).alias(f"{prefix}{d}") for d in domain]
    return out.select(*ids, *named)


def pivot_wider_values(df: DataFrame, ids: list[str], domain: dict[str, list], values: dict[str, Column], only: list[tuple] | None = None, fill: dict[str, object] | None = None, names_sep: str = "_", names_glue: str | None = None, id_expand: bool = False, unused: dict[str, Column] | None = None) -> DataFrame:
    """One column for each combination of the name columns' values and each of several aggregates.

    ``domain``: name columns with their values, all combinations of which become columns, or those of ``only``.
    ``names_glue`` names them, with ``{.value}`` and the name columns in braces; else the aggregate's name (if there are
    several) and the values are joined by ``names_sep``.  ``id_expand`` makes rows for all combinations of
    the id columns' values; ``unused`` are aggregates over all rows of an id.  Cells without rows hold null or ``fill``.
    """
    names = list(domain)
    cells = only if only is not None else list(product(*domain.values()))
    at = F.lit(None).cast("int")
    for k, cell in reversed(list(enumerate(cells))):
        same = F.lit(True)
        for c, v in zip(names, cell, strict=True):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        at = F.when(same, k).otherwise(at)
    # Two aggregates at least, so that pivoted names always hold the aggregate's.
    wide = df.withColumn("__cell", at).groupBy(*ids).pivot("__cell", list(range(len(cells)))).agg(*(c.alias(n) for n, c in values.items()), F.lit(0).alias("__"))

    def called(value: str, cell: tuple) -> str:
        parts = {c: "NA" if v is None else str(v) for c, v in zip(names, cell, strict=True)}
        if names_glue:
            return names_glue.replace("{.value}", "{__value}").format(__value=value, **parts)
        return names_sep.join([*([value] if len(values) > 1 else []), *parts.values()])

    def filled(value: str, k: int) -> Column:
        cell = F.col(f"`{k}_{value}`")
        return F.coalesce(cell, F.lit(fill[value])) if fill and value in fill else cell

    if id_expand:
        wide = join_groups(expand(df, *ids), wide, ids, "left")
    if unused:
        wide = join_groups(wide, df.groupBy(*ids).agg(*(c.alias(n) for n, c in unused.items())), ids, "left")
    return wide.select(*ids, *(filled(v, k).alias(called(v, cell)) for v in values for k, cell in enumerate(cells)), *(unused or ()))


def pivot_longer_sep(df: DataFrame, columns: list[str], separator: str, names_to: list[str], values_to: str = "value", transform: dict[str, str] | None = None) -> DataFrame:
    """Column names cut at a separator into ``names_to``, some of them cast by ``transform``; ``.value`` as in
    ``pivot_longer_pattern``."""
    pattern = re.escape(separator).join(["(.+?)"] * (len(names_to) - 1) + ["(.+)"])
    out = pivot_longer_pattern(df, columns, f"^{pattern}$", names_to, values_to)
    return out.withColumns({c: F.col(c).cast(t) for c, t in (transform or {}).items()})


def arrange_longer(df: DataFrame, keys: list[str], names_to: str, columns: list[str], cols_vary: str = "fastest") -> DataFrame:
    """A longer table in order: the columns of a row together (``fastest``), or the rows of a column (``slowest``)."""
    place = F.array_position(F.array(*map(F.lit, columns)), F.col(names_to))
    return df.orderBy(*([*keys, place] if cols_vary == "fastest" else [place, *keys]))


def crosstab(df: DataFrame, rows: str, columns: str, row_domain: list, column_domain: list) -> DataFrame:
    """Counts of every cell of two domains, 0 where there is none; rows of other values are left out."""
    counts = pivot_wider(df, [rows], columns, column_domain, F.count(F.lit(1)), fill=0)
    spark = df.sparkSession
    wanted = spark.createDataFrame([(k, v) for k, v in enumerate(row_domain)], f"__at int, {rows} {df.schema[rows].dataType.simpleString()}")
    out = wanted.join(counts, rows, "left").fillna(0, [str(c) for c in column_domain])
    return out.orderBy("__at").drop("__at")


def nest(df: DataFrame, by: list[str], name: str = "data") -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))


def unnest(df: DataFrame, name: str, keep_empty: bool = False) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, (F.inline_outer if keep_empty else F.inline)(name))


def chop(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Other columns as lists, all in one order."""
    rest = [c for c in df.columns if c not in by]
    rows = F.sort_array(F.collect_list(F.struct(*order, F.struct(*rest).alias("__all"))))
    packed = df.groupBy(*by).agg(rows.alias("__rows"))
    field = lambda name: lambda row: row["__all"][name]
    return packed.select(*by, *(F.transform("__rows", field(c)).alias(c) for c in rest))


def unchop(df: DataFrame, columns: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.arrays_zip(*columns)))


def pack(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in columns), F.struct(*columns).alias(name))


def unpack(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != name), f"{name}.*")


def unnest_longer(df: DataFrame, name: str, index: str | None = None, keep_empty: bool = False) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    if index:
        out = df.select(*rest, (F.posexplode_outer if keep_empty else F.posexplode)(name).alias(index, name))
        return out.withColumn(index, F.col(index) + 1)
    return df.select(*rest, (F.explode_outer if keep_empty else F.explode)(name).alias(name))


def hoist_json(df: DataFrame, name: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Fields of a JSON column by path and type; text that does not parse gives nulls."""
    return df.withColumns({new: F.get_json_object(name, path).try_cast(kind) for new, (path, kind) in paths.items()})


def separate_wider(df: DataFrame, name: str, into: list[str], delimiter: str) -> DataFrame:
    parts = F.split(F.col(name), re.escape(delimiter))
    return df.withColumns({new: F.get(parts, F.lit(k)) for k, new in enumerate(into)}).drop(name)


def separate_wider_position(df: DataFrame, name: str, widths: dict[str, int]) -> DataFrame:
    at, new = 1, {}
    for column, width in widths.items():
        new[column] = F.substring(F.col(name), at, width)
        at += width
    return df.withColumns(new).drop(name)


def separate_wider_regex(df: DataFrame, name: str, pattern: str, into: list[str]) -> DataFrame:
    """Groups of a pattern as columns; null where it does not match."""
    found = F.col(name).rlike(pattern)
    return df.withColumns({new: F.when(found, F.regexp_extract(name, pattern, k + 1)) for k, new in enumerate(into)}).drop(name)


def separate_wider_delim(df: DataFrame, name: str, delimiter: str, into: list[str], too_few: str = "error", too_many: str = "error", remove: bool = True) -> DataFrame:
    """Parts of a text as columns, with a rule for other numbers of parts than columns.

    ``too_few``: ``error``, ``align_start`` (nulls behind), ``align_end`` (nulls before) or ``debug``;
    ``too_many``: ``error``, ``drop``, ``merge`` (the rest stays in the last) or ``debug``.  With ``debug`` the text stays,
    and ``_ok``, ``_pieces`` and ``_remainder`` tell of each row.  A null text has null parts and is no error.
    """
    want = len(into)
    parts = F.split(F.col(name), re.escape(delimiter))
    n = F.size(parts)
    shift = F.when((n < want) & F.lit(too_few == "align_end"), want - n).otherwise(0)
    rest = F.array_join(F.slice(parts, F.lit(want), F.greatest(n - want + 1, F.lit(1))), delimiter)

    def part(k: int) -> Column:
        got = F.get(parts, F.lit(k) - shift)
        return F.when(n > want, rest).otherwise(got) if too_many == "merge" and k == want - 1 else got

    wrong = [F.when(n < want, F.raise_error(F.concat(F.lit(f"too few parts of {name}: "), F.col(name))))] if too_few == "error" else []
    wrong += [F.when(n > want, F.raise_error(F.concat(F.lit(f"too many parts of {name}: "), F.col(name))))] if too_many == "error" else []
    checked = df.where(F.coalesce(*(w.cast("boolean") for w in wrong), F.lit(True))) if wrong else df
    out = checked.withColumns({new: part(k) for k, new in enumerate(into)})
    debug = "debug" in (too_few, too_many)
    if debug:
        over = F.array_join(F.slice(parts, F.lit(want + 1), F.greatest(n - want, F.lit(0))), delimiter)
        left = F.when(n > want, F.concat(F.lit(delimiter), over)).when(F.col(name).isNotNull(), "")
        out = out.withColumns({f"{name}_ok": F.coalesce(n == want, F.lit(True)), f"{name}_pieces": F.when(F.col(name).isNotNull(), n), f"{name}_remainder": left})
    return out.drop(name) if remove and not debug and name not in into else out


def separate_longer(df: DataFrame, name: str, delimiter: str) -> DataFrame:
    """A row for each part; a null stays a row."""
    return df.withColumn(name, F.explode_outer(F.split(F.col(name), re.escape(delimiter))))


def separate_longer_position(df: DataFrame, name: str, width: int) -> DataFrame:
    """A row for each piece of so many characters; a null stays a row, an empty text has no piece."""
    starts = F.when(F.length(name) > 0, F.sequence(F.lit(1), F.length(name), F.lit(width)))
    kept = df.where((F.length(name) > 0) | F.col(name).isNull())
    return kept.withColumn(name, F.explode_outer(F.transform(starts, lambda s: F.substring(F.col(name), s, F.lit(width)))))


def unite(df: DataFrame, name: str, columns: list[str], separator: str = "_", remove: bool = True, na_rm: bool = True) -> DataFrame:
    """Columns joined by a separator; nulls are left out, or with ``na_rm=False`` said as NA."""
    said = [F.col(c).cast("string") for c in columns]
    out = df.withColumn(name, F.concat_ws(separator, *(said if na_rm else [F.coalesce(c, F.lit("NA")) for c in said])))
    return out.drop(*[c for c in columns if c != name]) if remove else out


def expand(df: DataFrame, *columns: str) -> DataFrame:
    """All combinations of the distinct values of columns: as many rows as the domains' product."""
    out = df.select(columns[0]).distinct()
    for c in columns[1:]:
        out = out.crossJoin(df.select(c).distinct())
    return out


def complete(df: DataFrame, *columns: str, fill: dict | None = None) -> DataFrame:
    """Rows for all combinations of the columns' values, null among them; new ones hold null or ``fill``."""
    found = join_groups(expand(df, *columns), df, columns, "left").select(*columns, *(c for c in df.columns if c not in columns))
    return found.fillna(fill or {})


def full_seq(df: DataFrame, column: str, step: int = 1) -> DataFrame:
    """Every value from the lowest to the highest in steps."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.lit(step))).alias(column))


def fill_down(df: DataFrame, columns: list[str], order: list[str], by: list[str], direction: str = "down") -> DataFrame:
    """Nulls take the last value before them (``up``: the next after; ``downup``: both in turn)."""
    w = W.Window.partitionBy(*by).orderBy(*order)
    before, after = w.rowsBetween(W.Window.unboundedPreceding, 0), w.rowsBetween(0, W.Window.unboundedFollowing)
    down = lambda c: F.last(c, ignorenulls=True).over(before)
    up = lambda c: F.first(c, ignorenulls=True).over(after)
    value = {"down": down, "up": up, "downup": lambda c: F.coalesce(down(c), up(c)), "updown": lambda c: F.coalesce(up(c), down(c))}[direction]
    return df.withColumns({c: value(c) for c in columns})


def longer_spec(columns: list[str], pattern: str, names_to: list[str], values_to: str = "value") -> list[dict[str, str]]:
    """What each column becomes, as rows: its name, its value column (``.value``) and its name parts."""
    out = []
    for c in columns:
        parts = dict(zip(names_to, re.fullmatch(pattern, c).groups(), strict=True))
        out.append({".name": c, ".value": parts.pop(".value", values_to), **parts})
    return out


def pivot_longer_spec(df: DataFrame, spec: list[dict[str, str]]) -> DataFrame:
    """Longer by a specification table; columns that it does not name are ids."""
    keys = [k for k in spec[0] if not k.startswith(".")]
    values = list(dict.fromkeys(r[".value"] for r in spec))
    groups: dict[tuple, dict[str, str]] = {}
    for r in spec:
        groups.setdefault(tuple(r[k] for k in keys), {})[r[".value"]] = r[".name"]
    rows = [F.struct(*(F.lit(x).alias(k) for k, x in zip(keys, key, strict=True)), *((F.col(g[v]) if v in g else F.lit(None)).alias(v) for v in values)) for key, g in groups.items()]
    named = {r[".name"] for r in spec}
    return df.select(*(c for c in df.columns if c not in named), F.inline(F.array(*rows)))


def wider_spec(domain: list[tuple], names_from: list[str], values_from: list[str], separator: str = "_") -> list[dict[str, object]]:
    """One row a new column: its name, the value column it is filled from, and the key of its cells."""
    many = len(values_from) > 1
    return [{".name": separator.join(map(str, ([v] if many else []) + list(key))), ".value": v, **dict(zip(names_from, key, strict=True))} for v in values_from for key in domain]


def pivot_wider_spec(df: DataFrame, spec: list[dict[str, object]], ids: list[str], value=F.first, fill: object = None) -> DataFrame:
    """Wider by a specification table; ``value`` aggregates the rows of a cell."""
    keys = [k for k in spec[0] if not k.startswith(".")]
    cells = []
    for r in spec:
        test = F.lit(True)
        for k in keys:
            test = test & F.col(k).eqNullSafe(F.lit(r[k]))
        cell = value(F.when(test, F.col(r[".value"])), ignorenulls=True) if value in (F.first, F.last) else value(F.when(test, F.col(r[".value"])))
        cells.append((cell if fill is None else F.coalesce(cell, F.lit(fill))).alias(r[".name"]))
    return df.groupBy(*ids).agg(*cells)


def unnest_wider(df: DataFrame, name: str, separator: str = "") -> DataFrame:
    """Fields of a struct column as columns, prefixed by its name if a separator is given."""
    fields = df.schema[name].dataType.names
    return df.select(*(c for c in df.columns if c != name), *(F.col(f"{name}.{f}").alias(f"{name}{separator}{f}" if separator else f) for f in fields))


def unnest_auto(df: DataFrame, name: str) -> DataFrame:
    """Structs go wider, lists longer."""
    from pyspark.sql import types as T

    return unnest_wider(df, name) if isinstance(df.schema[name].dataType, T.StructType) else unnest_longer(df, name)


def nesting(df: DataFrame, *columns: str) -> DataFrame:
    """Only the combinations that occur."""
    return df.select(*columns).distinct()


def expand_grid(spark, **domains: list) -> DataFrame:
    """All combinations of given lists: a table of parameters."""
    out = None
    for name, values in domains.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(one)
    return out


def replace_na(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def drop_na(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns) or df.columns)
