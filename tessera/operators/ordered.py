"""Numbers, ranks and running sums over a whole table in order, without one task that holds it.

A table is cut into ranges of its order by bounds taken from a small sample by hash, which every reading of
the table makes alike.  The first pass sums each range, the second adds what lies in the ranges before to
what a window counts inside each range.  Orders are lists of column names, ``-name`` for falling; nulls come
last.  Equal keys lie in one range, so an order should end in a key of the rows, which also makes numbers
unambiguous; ranks are taken over counted distinct values and joined back, so a frequent value is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.operators.verbs import join_groups

#: Rows of a range, ranges at most, and sampled keys a range.
RANGE_ROWS, MOST_RANGES, SAMPLED = 2_000_000, 2000, 40
#: Ranges up to which a row's range is found by a tree of comparisons instead of a loop over the bounds.
TREE_RANGES = 32


def _falls(name: str) -> tuple[str, bool]:
    return (name[1:], True) if name.startswith("-") else (name, False)


def sorting(order: list[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in map(_falls, order)]


def _before(a: Column, b: Column, order: list[str], equal: bool) -> Column:
    """Whether the key ``a`` comes before ``b`` (or equals it); keys are structs of the order's columns."""
    out = F.lit(equal)
    for k, (_, down) in reversed(list(enumerate(map(_falls, order)))):
        x, y = a[f"k{k}"], b[f"k{k}"]
        less = (x.isNotNull() & y.isNull()) | F.coalesce(x > y if down else x < y, F.lit(False))
        out = less | (x.eqNullSafe(y) & out)
    return out


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None, name: str = "__range") -> DataFrame:
    """``df`` with the number of the range of its order that each row lies in."""
    total = df.count()
    ranges = ranges or min(MOST_RANGES, -(-total // RANGE_ROWS))
    if ranges <= 1:
        return df.withColumn(name, F.lit(0))
    columns = [c for c, _ in map(_falls, order)]
    key = F.struct(*(F.col(c).alias(f"k{k}") for k, c in enumerate(columns)))
    share = F.pmod(F.xxhash64(*columns), F.lit(1 << 62)) / F.lit(float(1 << 62)) * F.lit(total) < SAMPLED * ranges
    sample = df.where(share).select(key.alias("key")).distinct()
    compare = lambda a, b: F.when(_before(a, b, order, False), -1).when(_before(b, a, order, False), 1).otherwise(0)
    sorted_keys = sample.agg(F.array_sort(F.collect_list("key"), compare).alias("keys"))  # about SAMPLED times ranges
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("keys", F.floor(i * F.size("keys") / ranges).cast("int")))
    bounds = sorted_keys.select(F.filter(at, lambda k: k.isNotNull()).alias("bounds")).scalar()
    with_bounds = df.withColumn("__key", key).withColumn("__bounds", bounds)
    if ranges <= TREE_RANGES:  # comparisons of columns, which are compiled

        def place(low: int, high: int) -> Column:
            if low >= high:
                return F.lit(low)
            middle = (low + high) // 2
            above = (F.size("__bounds") > middle) & _before(F.get("__bounds", F.lit(middle)), F.col("__key"), order, True)
            return F.when(above, place(middle + 1, high)).otherwise(place(low, middle))

        return with_bounds.withColumn(name, place(0, ranges - 1)).drop("__key", "__bounds")
    span = F.struct(F.lit(0).alias("low"), F.size("__bounds").alias("high"))

    def halve(found: Column, _: Column) -> Column:
        middle = F.floor((found["low"] + found["high"]) / 2).cast("int")
        above = _before(F.get("__bounds", middle), F.col("__key"), order, True)
        return F.when(found["low"] >= found["high"], found).when(above, F.struct((middle + 1).alias("low"), found["high"].alias("high"))).otherwise(F.struct(found["low"].alias("low"), middle.alias("high")))

    steps = F.sequence(F.lit(0), F.lit(int(ranges).bit_length()))
    return with_bounds.withColumn(name, F.aggregate(steps, span, halve)["low"]).drop("__key", "__bounds")


def _sums_before(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """For each range the sums over all ranges before it; as many rows as ranges."""
    totals = placed.groupBy("__range").agg(*(F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()))
    every = totals.agg(F.collect_list(F.struct("__range", *sums)).alias("every"))
    before = lambda x, n: F.aggregate(F.filter("every", lambda y: y["__range"] < x["__range"]), F.lit(0).cast(totals.schema[n].dataType), lambda s, y: (s + y[n]).cast(totals.schema[n].dataType))
    offsets = F.transform("every", lambda x: F.struct(x["__range"].alias("__range"), *(before(x, n).alias(f"__before_{n}") for n in sums)))
    return every.select(F.inline(offsets))


def scanned(df: DataFrame, order: list[str], ranges: int | None = None, **columns: Column | None) -> DataFrame:
    """Running sums of columns in order, each including its row; ``None`` counts rows.

    Nulls add nothing.  A column of whole numbers is summed as such, so its result does not depend on ranges.
    """
    placed = in_ranges(df, order, ranges)
    values = {n: F.lit(1).cast("long") if c is None else c for n, c in columns.items()}
    offsets = _sums_before(placed, {n: F.sum(c) for n, c in values.items()})
    w = W.Window.partitionBy("__range").orderBy(*sorting(order)).rowsBetween(W.Window.unboundedPreceding, 0)
    inside = placed.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in values.items()})
    out = inside.join(F.broadcast(offsets), "__range").withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in columns})  # a row a range
    return out.drop("__range", *(f"__before_{n}" for n in columns))


def row_number(df: DataFrame, order: list[str], name: str = "row_number", ranges: int | None = None) -> DataFrame:
    """Numbers from 1 in order over the whole table."""
    return scanned(df, order, ranges, **{name: None})


def ntile(df: DataFrame, order: list[str], n: int, name: str = "bucket", ranges: int | None = None) -> DataFrame:
    """``n`` buckets of the whole table in order, larger ones first, sizes at most one apart."""
    numbered = row_number(df, order, "__number", ranges)
    total = df.agg(F.count("*").alias("__total"))
    place, size, more = F.col("__number") - 1, F.floor(F.col("__total") / n), F.col("__total") % n
    bucket = F.when(place < more * (size + 1), F.floor(place / (size + 1))).otherwise(more + F.floor((place - more * (size + 1)) / size)) + 1
    return numbered.join(F.broadcast(total)).withColumn(name, bucket.cast("int")).drop("__number", "__total")  # one row


def ranks(df: DataFrame, order: list[str], min_rank: str | None = None, dense_rank: str | None = None, percent_rank: str | None = None, cume_dist: str | None = None, ranges: int | None = None) -> DataFrame:
    """Ranks of the whole table by the values of some columns; equal values (nulls too) have equal ranks."""
    columns = [c for c, _ in map(_falls, order)]
    counted = df.groupBy(*columns).agg(F.count("*").alias("__many"))
    seen = scanned(counted, order, ranges, __upto=F.col("__many"), __dense=None)
    total = df.agg(F.count("*").alias("__total"))
    first = F.col("__upto") - F.col("__many") + 1
    asked = {min_rank: first, dense_rank: F.col("__dense"), percent_rank: F.when(F.col("__total") > 1, (first - 1) / (F.col("__total") - 1)).otherwise(0.0), cume_dist: F.col("__upto") / F.col("__total")}
    known = seen.join(F.broadcast(total)).select(*columns, *(c.alias(n) for n, c in asked.items() if n))  # one row
    return join_groups(df, known, columns)


def row_number_within(df: DataFrame, by: list[str], order: list[str], name: str = "row_number", ranges: int | None = None) -> DataFrame:
    """Numbers from 1 in order within each key, null keys included; a key with most of the rows is many ranges."""
    numbered = row_number(ranks(df, by, min_rank="__first"), ["__first", *order], "__number", ranges)
    return numbered.withColumn(name, F.col("__number") - F.col("__first") + 1).drop("__number", "__first")
