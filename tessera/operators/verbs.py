"""Row verbs: filters, counts, distinct rows, slices, set operations and group metadata.

Ties are always broken by an explicit key, never by arrival.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _names(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def filter_out(df: DataFrame, condition: Column) -> DataFrame:
    """Drops rows where the condition is true; rows where it is null stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=columns or df.columns)


def mutate(df: DataFrame, keep: str = "all", before: str | None = None, after: str | None = None, **columns: Column) -> DataFrame:
    """Adds columns one after the other, so later ones see earlier ones.

    ``keep='none'`` returns new columns alone; ``before`` and ``after`` place them.
    """
    out = df
    for name, value in columns.items():
        out = out.withColumn(name, value)
    new = list(columns)
    if keep == "none":
        return out.select(*new)
    if before or after:
        rest = [c for c in out.columns if c not in new]
        at = rest.index(before) if before else rest.index(after) + 1
        return out.select(*rest[:at], *new, *rest[at:])
    return out


def count(df: DataFrame, *by: str, name: str = "n", weight: str | None = None, sort: bool = False) -> DataFrame:
    n = F.sum(weight) if weight else F.count("*")
    out = df.groupBy(*by).agg(n.alias(name))
    return out.orderBy(F.desc(name), *by) if sort else out


def add_count(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """Each row with the size of its group, joined from partial counts so that no group is one task."""
    sizes = df.groupBy(*(F.col(k).alias(f"__{k}") for k in by)).agg(F.count("*").alias(name))
    test = F.lit(True)
    for k in by:
        test = test & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(sizes, test).select(*df.columns, name)


class Grouped(NamedTuple):
    """A table and the columns that it is grouped by."""

    df: DataFrame
    by: tuple[str, ...]


def summarise_groups(grouped: Grouped, groups: str = "drop_last", **columns: Column) -> Grouped:
    """One row a group, and what stays of the grouping: all but the last column, ``drop`` none, ``keep`` all,
    ``rowwise`` every column, so that each row is a group."""
    out = summarise(grouped.df, list(grouped.by), **columns)
    rest = {"drop_last": grouped.by[:-1], "drop": (), "keep": grouped.by, "rowwise": tuple(out.columns)}
    if groups not in rest:
        raise ValueError(f"{groups} is no grouping")
    return Grouped(out, rest[groups])


def summarise(df: DataFrame, by, **columns: Column) -> DataFrame:
    return df.groupBy(*_names(by)).agg(*(c.alias(n) for n, c in columns.items()))


def first_rows(df: DataFrame, key, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key in an explicit order; Spark keeps n per task before the shuffle."""
    w = W.Window.partitionBy(*(key if isinstance(key, list) else [key])).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def first_wins(df: DataFrame, key, ingest: str) -> DataFrame:
    return first_rows(df, key, [F.col(ingest).asc()])


def last_wins(df: DataFrame, key, ingest: str) -> DataFrame:
    return first_rows(df, key, [F.col(ingest).desc()])


def best_rows(df: DataFrame, key, score: Column, ingest: str) -> DataFrame:
    """The row of highest score of each key, the first ingested of equals."""
    return first_rows(df, key, [score.desc_nulls_last(), F.col(ingest).asc()])


def having_count(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys with so many rows at least; keys are counted, then semi-joined."""
    enough = df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key)
    return df.join(enough, key, "left_semi")


def slice_head(df: DataFrame, n: int, by, order: list) -> DataFrame:
    return first_rows(df, _names(by), order, n) if by else df.orderBy(*order).limit(n)


def slice_max(df: DataFrame, column: str, n: int = 1, by=(), ties: bool = True, key: list | None = None) -> DataFrame:
    """Rows of the n highest values of each group; with ties all rows of the last value."""
    w = W.Window.partitionBy(*_names(by)).orderBy(F.col(column).desc_nulls_last(), *([] if ties else key or []))
    rank = F.rank() if ties else F.row_number()
    return df.withColumn("__rank", rank.over(w)).where((F.col("__rank") <= n) & F.col(column).isNotNull()).drop("__rank")


def slice_min(df: DataFrame, column: str, n: int = 1, by=(), ties: bool = True, key: list | None = None) -> DataFrame:
    w = W.Window.partitionBy(*_names(by)).orderBy(F.col(column).asc_nulls_last(), *([] if ties else key or []))
    rank = F.rank() if ties else F.row_number()
    return df.withColumn("__rank", rank.over(w)).where((F.col("__rank") <= n) & F.col(column).isNotNull()).drop("__rank")


def slice_sample(df: DataFrame, n: int, key: list[str], by=(), seed: int = 42) -> DataFrame:
    """A reproducible sample without replacement: lowest hashes of (seed, key) first."""
    order = [F.xxhash64(F.lit(seed), *key), *map(F.col, key)]
    return slice_head(df, n, by, order)


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on nothing but its parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def weighted_sample(df: DataFrame, n: int, weight: str, key: list[str], by=(), seed: int = 42) -> DataFrame:
    """A reproducible sample without replacement, each next row with a chance in proportion to its weight.

    Every row waits an exponential time of its weight as rate, and the first n are taken.  Rows of no or null weight
    are never drawn, so fewer than n may come.
    """
    wait = -F.log(_uniform(F.lit(seed), *map(F.col, key))) / F.col(weight)
    waiting = df.where(F.col(weight) > 0).withColumn("__wait", wait)
    return slice_head(waiting, n, by, [F.col("__wait"), *map(F.col, key)]).drop("__wait")


def replacement_sample(df: DataFrame, n: int, key: list[str], weight: str | None = None, by=(), seed: int = 42, ranges: int | None = None) -> DataFrame:
    """n draws with replacement of each group, rows as often as they are drawn, with the ``draw`` they are.

    Each row owns a stretch of its group's weights in order of the key, by a running sum over ranges; each
    draw is a point of that line by hash of (seed, group, draw).  So the sample is the same however the table is
    partitioned, and no group is one task.  Weights count in millionths of the largest; groups without one yield nothing.
    """
    from tessera.operators.joins import interval_join
    from tessera.operators.ordered import scanned

    by = _names(by)
    if weight:
        largest = df.agg(F.max(weight).alias("__largest"))
        weighed = df.join(F.broadcast(largest)).withColumn("__w", F.round(F.col(weight) / F.col("__largest") * 1_000_000).cast("long")).drop("__largest")  # one row
    else:
        weighed = df.withColumn("__w", F.lit(1).cast("long"))
    rows = weighed.where(F.col("__w") > 0)
    line = scanned(rows, [*by, *key], ranges, __upto=F.col("__w")).withColumn("__from", F.col("__upto") - F.col("__w"))
    groups = line.groupBy(*by).agg(F.min("__from").alias("__start"), F.max("__upto").alias("__stop"))
    draws = groups.select("__start", "__stop", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"), *(F.col(c).alias(f"__g_{c}") for c in by))
    share = _uniform(F.lit(seed), F.col("draw"), *(F.coalesce(F.col(f"__g_{c}").cast("string"), F.lit("\0")) for c in by))
    points = draws.select("draw", (F.col("__start") + F.floor(share * (F.col("__stop") - F.col("__start")))).alias("__point"))
    return interval_join(points, line, "__point", "__from", "__upto", bounds="[)").select(*df.columns, "draw")


def quota_sample(df: DataFrame, stratum: str, quota: dict[str, int], key: list[str], seed: int = 42) -> DataFrame:
    """So many rows of each stratum, by hash order; strata without a quota are left out."""
    table = F.create_map(*(F.lit(x) for kv in quota.items() for x in kv))
    w = W.Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    ranked = df.where(F.col(stratum).isin(*quota)).withColumn("__rank", F.row_number().over(w))
    most = max(quota.values(), default=0)  # as a number, so that each task sends no more of a stratum than that
    return ranked.where((F.col("__rank") <= most) & (F.col("__rank") <= F.element_at(table, F.col(stratum)))).drop("__rank")


def symdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def setequal(a: DataFrame, b: DataFrame) -> bool:
    return symdiff(a, b).isEmpty()


def bind_rows(*tables: DataFrame, source: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Rows of all tables by column name; missing columns are null; a source column names the table."""
    named = [t.withColumn(source, F.lit((names or list(map(str, range(1, len(tables) + 1))))[k])) if source else t for k, t in enumerate(tables)]
    out = named[0]
    for t in named[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def bind_cols(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns side by side by an explicit row id (tables have no row order)."""
    return a.join(b, key, "full")


def group_keys(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by).distinct().orderBy(*by)


def join_groups(df: DataFrame, groups: DataFrame, by, how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``groups``, by keys of which null is one like any other."""
    test = F.lit(True)
    for c in by:
        test = test & F.col(f"`{c}`").eqNullSafe(F.col(f"`__group_{c}`"))
    side = groups.withColumnsRenamed({c: f"__group_{c}" for c in by})
    return df.join(side, test, how).drop(*(f"__group_{c}" for c in by))


def group_ids(df: DataFrame, *by: str, name: str = "group_id") -> DataFrame:
    """Each row with the number of its group in key order, from 1; a null key is a group, the last."""
    from tessera.operators.ordered import ranks

    return ranks(df, list(by), dense_rank=name).withColumn(name, F.col(name).cast("int"))


def group_nest(df: DataFrame, by, name: str = "data") -> DataFrame:
    """One row a group with its other columns as a list of structs, in value order."""
    rest = [c for c in df.columns if c not in _names(by)]
    return df.groupBy(*_names(by)).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))


def uncount(df: DataFrame, n: str, row_id: str | None = None) -> DataFrame:
    """Each row n times; rows of 0, negative or null n vanish."""
    copies = F.when(F.col(n) >= 1, F.sequence(F.lit(1), F.col(n).cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(row_id or "__copy", F.explode(copies)).drop(n, *([] if row_id else ["__copy"]))


def consecutive_id(df: DataFrame, value: str, order: list[str], by=(), name: str = "run") -> DataFrame:
    """Number of each run of equal values (nulls are equal) in order."""
    w = W.Window.partitionBy(*_names(by)).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    marked = df.withColumn("__new", new)
    return marked.withColumn(name, F.sum("__new").over(w.rowsBetween(W.Window.unboundedPreceding, 0))).drop("__new")


def arrange(df: DataFrame, *order: Column | str, by=()) -> DataFrame:
    """Rows in order, nulls last, groups first if asked for."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.orderBy(*_names(by), *(c.asc_nulls_last() if isinstance(o, str) else c for o, c in zip(order, columns, strict=True)))


def pull(df: DataFrame, column: str, order: str | None = None) -> list:
    """One column as a list of the driver; for small results."""
    return [r[0] for r in (df.orderBy(order) if order else df).select(column).collect()]


def reframe(df: DataFrame, by, **columns: Column) -> DataFrame:
    """Any number of rows a group: columns are aggregates that give arrays of one length."""
    arrays = df.groupBy(*_names(by)).agg(*(c.alias(n) for n, c in columns.items()))
    return arrays.select(*_names(by), F.inline(F.arrays_zip(*columns)))


def group_apply(df: DataFrame, by, function, schema: str) -> DataFrame:
    """A pandas function over each group; for groups that fit a task."""
    return df.groupBy(*_names(by)).applyInPandas(function, schema)


def slice_tail(df: DataFrame, n: int, by, order: list[str]) -> DataFrame:
    return first_rows(df, _names(by), [F.col(c).desc() for c in order], n) if by else df.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def slice_range(df: DataFrame, first: int, last: int, order: list, by=()) -> DataFrame:
    """Rows first to last of each group in order, from 1."""
    w = W.Window.partitionBy(*_names(by)).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank").between(first, last)).drop("__rank")


def slice_fraction(df: DataFrame, fraction: float, key: list[str], seed: int = 42) -> DataFrame:
    """Rows whose hash falls in a fraction; the same rows however the table is partitioned."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_000)) < int(fraction * 1_000_000))


def rows_with_domain(df: DataFrame, domain: DataFrame, key: str, fill: dict) -> DataFrame:
    """Groups of a domain, those without rows as well."""
    return domain.join(df, key, "left").fillna(fill)


def pack_counts(df: DataFrame, by, value: str, name: str = "counts") -> DataFrame:
    """For each group its values with their counts as one JSON object, the most frequent first, then by value.

    Nulls are not counted.  A group's object has as many entries as the group has distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*_names(by), F.col(value).cast("string").alias("k")).agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "k")))
    return counted.groupBy(*_names(by)).agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], -e["m"])))).alias(name))
