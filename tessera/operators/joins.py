"""Joins by intent: lookups, range, rolling and overlap joins, keyed row changes.

Range and rolling joins are equi-joins: sides are cut into ranges, or intervals are stored in cells of a
hierarchy, and a filter on what meets there replaces the nested loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tessera.operators.ordered import MOST_RANGES, in_ranges, scanned, sorting
from tessera.operators.verbs import join_groups, last_wins


def null_safe(left: list[str], right: list[str]) -> Column:
    """Equality of key columns, in which null equals null."""
    test = F.lit(True)
    for a, b in zip(left, right, strict=True):
        test = test & F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
    return test


def check_relationship(a: DataFrame, b: DataFrame, keys: list[str], relationship: str) -> None:
    """Stops if a key is repeated on a side that must have it once (``one-to-one``, ``many-to-one``, ...)."""
    left, _, right = relationship.partition("-to-")
    for side, df, how in (("left", a, left), ("right", b, right)):
        if how == "one" and not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"the {side} side repeats a key; the relationship is {relationship}")


def mutating_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left", suffix: tuple[str, str] = (".x", ".y"), relationship: str = "many-to-many", unmatched: str = "drop", multiple: str = "all", order: list | None = None, keep: bool = False, unmatched_right: str = "drop") -> DataFrame:
    """Left, inner, right or full join with null-safe keys, suffixes for clashing columns and checks.

    ``multiple``: ``first`` or ``last`` keeps one match of each left row by ``order``, ``any`` one whatever it is (the
    least of its columns); ``error`` refuses several.  ``unmatched="error"`` refuses left rows without a match,
    ``unmatched_right="error"`` right rows without one, which a left or inner join would drop.
    ``keep`` returns the keys of both sides, with suffixes.
    """
    check_relationship(a, b, keys, relationship)
    if unmatched_right == "error" and not _unlike(b, a, keys, "left_anti").isEmpty():
        raise ValueError("a right row has no match")
    if multiple == "error" and not a.join(b.groupBy(*(F.col(k).alias(f"__right_{k}") for k in keys)).count().where("count > 1"), null_safe(keys, [f"__right_{k}" for k in keys]), "left_semi").isEmpty():
        raise ValueError("a left row has several matches")
    if unmatched == "error" and not a.join(b.select(*(F.col(k).alias(f"__right_{k}") for k in keys)), null_safe(keys, [f"__right_{k}" for k in keys]), "left_anti").isEmpty():
        raise ValueError("a left row has no match")
    if multiple in ("first", "last", "any"):
        wanted = (order if multiple != "any" else None) or [F.col(c) for c in b.columns if c not in keys]
        w = W.Window.partitionBy(*keys).orderBy(*([F.desc(c) if isinstance(c, str) else c.desc() for c in wanted] if multiple == "last" else wanted))
        b = b.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
    clash = set(a.columns) & set(b.columns) - set(keys)
    side = b.toDF(*(f"__right_{c}" for c in b.columns))
    joined = a.join(side, null_safe(keys, [f"__right_{k}" for k in keys]), how)
    pair = lambda k: (F.col(f"`{k}`"), F.col(f"`__right_{k}`"))
    key = [(F.coalesce(*pair(k)) if how == "full" else pair(k)[how == "right"]).alias(k) for k in keys]
    if keep:
        key = [side.alias(k + x) for k in keys for side, x in zip(pair(k), suffix, strict=True)]
    left = [pair(c)[0].alias(c + suffix[0] * (c in clash)) for c in a.columns if c not in keys]
    right = [pair(c)[1].alias(c + suffix[1] * (c in clash)) for c in b.columns if c not in keys]
    return joined.select(*key, *left, *right)


def lookup(a: DataFrame, b: DataFrame, key: str, values: dict[str, object]) -> DataFrame:
    """Values of ``b`` by key, each with a default where there is none; ``b`` has a key once."""
    joined = join_groups(a, b.select(key, *values), [key], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in values.items()})


def only_new_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Left join of those columns of ``b`` that ``a`` has not; null keys meet."""
    return join_groups(a, b.drop(*[c for c in b.columns if c in a.columns and c != key]), [key], "left")


def resume(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of the source whose key is not done yet (a blank or null key is a key)."""
    return _unlike(source, done, [key], "left_anti")


def replace_overlap(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones whose key is not among them; null keys meet."""
    return _unlike(old, new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def fill_only(base: DataFrame, later: DataFrame, key: str, label: str, *travelling: str) -> DataFrame:
    """Adds keys and fills empty labels from a later source; a label is never overwritten, and the
    travelling columns come from the source of the label.  Null keys meet."""
    left = base.select(F.col(key).alias("__a_key"), F.col(label).alias("__a"), *(F.col(t).alias(f"__a_{t}") for t in travelling))
    right = later.select(F.col(key).alias("__b_key"), F.col(label).alias("__b"), *(F.col(t).alias(f"__b_{t}") for t in travelling))
    joined = left.join(right, null_safe(["__a_key"], ["__b_key"]), "full").withColumn(key, F.coalesce("__a_key", "__b_key"))
    old = F.nullif(F.col("__a"), F.lit(""))
    return joined.select(key, F.coalesce(old, F.col("__b"), F.col("__a")).alias(label), *(F.when(old.isNotNull() | F.col("__b").isNull(), F.col(f"__a_{t}")).otherwise(F.col(f"__b_{t}")).alias(t) for t in travelling))


def two_hop(predictions: DataFrame, links: DataFrame, targets: DataFrame, first: str, second: str, ingest: str) -> DataFrame:
    """Predictions by one key to targets by another; a later prediction of one target key replaces an earlier.

    Null keys meet, as they do in a lookup table.
    """
    reached = join_groups(predictions, links, [first])
    return join_groups(targets, last_wins(reached, second, ingest).drop(first), [second], "left")


def nest_join(a: DataFrame, b: DataFrame, key: str, name: str = "matches") -> DataFrame:
    """Matches of each row as a list of structs, empty where there is none; null keys meet."""
    rest = [c for c in b.columns if c != key]
    lists = b.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
    kind = lists.schema[name].dataType.simpleString()
    return join_groups(a, lists, [key], "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def asof_join(a: DataFrame, b: DataFrame, by: list[str], time_a: str, time_b: str, columns: list[str], tie: str, closest: str = ">=", ranges: int | None = None) -> DataFrame:
    """For each row the closest row of ``b`` whose time stands to its own as asked: ``closest`` is the
    test of the left time against the right one, ``>=`` and ``>`` (the last before), ``<=`` and ``<`` (the
    first after).  Of equal times the largest ``tie`` counts, or the smallest for those after.  A null time is close to none.

    Both sides are one sequence by key and time, cut into ranges of time whatever the key, so a key of most rows
    is many tasks.  A window carries the last value forward inside a range; keys that go on in a later
    range, at most one a range, bring their last value along.
    """
    back, strict = closest in (">=", ">"), closest in (">", "<")
    if closest not in (">=", ">", "<=", "<"):
        raise ValueError(f"{closest} is no order")
    right = F.struct(*(F.col(c) for c in columns))
    keys = [f"__k{k}" for k in range(len(by))]
    key = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    left_rows = a.select(*key, F.col(time_a).alias("__t"), F.lit(0 if strict else 2).alias("__side"), F.lit(None).cast(b.schema[tie].dataType).alias("__tie"), F.struct(*a.columns).alias("__a"), F.lit(None).cast(b.select(right.alias("x")).schema["x"].dataType).alias("__b"))
    right_rows = b.where(F.col(time_b).isNotNull()).select(*key, F.col(time_b).alias("__t"), F.lit(1).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(left_rows.schema["__a"].dataType).alias("__a"), right.alias("__b"))
    turned = "" if back else "-"
    order = [f"{turned}__t", "__side", f"{turned}__tied", f"{turned}__tie"]
    placed = in_ranges(left_rows.unionByName(right_rows).withColumn("__tied", F.col("__tie").isNotNull()), [*keys, *order], ranges)
    w = W.Window.partitionBy("__range", *keys).orderBy(*sorting(order)).rowsBetween(W.Window.unboundedPreceding, 0)
    inside = placed.withColumn("__last", F.last("__b", ignorenulls=True).over(w))
    spans = placed.groupBy(*keys).agg(F.min("__range").alias("__from"), F.max("__range").alias("__to")).where(F.col("__from") < F.col("__to"))
    spans = F.broadcast(spans)  # each bound between ranges lies in one key
    place = F.struct(*(F.col(c) for c in ("__t", "__tie")))
    latest = F.max_by("__b", place) if back else F.min_by("__b", place)
    ends = join_groups(placed.where("__side = 1"), spans, keys).groupBy("__range", *keys).agg(latest.alias("__end"))
    every = spans.select(*keys, F.explode(F.sequence(F.col("__from") + 1, F.col("__to"))).alias("__range"))
    sequence = every.withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType)).withColumn("__asks", F.lit(1)).unionByName(ends.withColumn("__asks", F.lit(2)))
    before = W.Window.partitionBy(*keys).orderBy("__range", "__asks").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = sequence.withColumn("__before", F.last("__end", ignorenulls=True).over(before)).where("__asks = 1").select("__range", *keys, "__before")
    both = join_groups(inside.where("__side <> 1"), F.broadcast(carried), ["__range", *keys], "left").withColumn("__last", F.coalesce("__last", "__before"))
    return both.select("__a.*", *(F.when(F.col("__t").isNotNull(), F.col(f"__last.{c}")).alias(c) for c in columns))


_TESTS = {">=": lambda x, y: x >= y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, "<": lambda x, y: x < y}


def inequality_join(a: DataFrame, b: DataFrame, left: str, test: str, right: str, by: tuple[str, ...] = (), how: str = "inner", ranges: int | None = None) -> DataFrame:
    """Pairs with ``left test right`` (>=, >, <= or <) and equal ``by`` columns, in the columns of both sides.

    Both sides are cut at the same bounds.  A range of ``a`` meets its own range of ``b`` and all on the side that
    the test asks for, to which rows of ``b`` are dealt; so beside the pairs of one range all that meet are results,
    no range holds all, and nothing is compared in a nested loop.  ``semi`` and ``anti`` ask for the
    extreme of ``b`` only.  Null values and null keys meet nothing; other columns of both sides must differ in name.
    """
    if test not in _TESTS:
        raise ValueError(f"{test} is no order")
    rising = test in (">=", ">")
    if how in ("semi", "anti"):
        extreme = b.groupBy(*(F.col(c).alias(f"__e_{c}") for c in by)).agg((F.min if rising else F.max)(right).alias("__extreme"))
        same = F.lit(True)
        for c in by:
            same = same & (F.col(c) == F.col(f"__e_{c}"))
        known = a.join(extreme, same, "left") if by else a.join(F.broadcast(extreme))  # one row
        holds = F.coalesce(_TESTS[test](F.col(left), F.col("__extreme")), F.lit(False))
        return known.where(holds if how == "semi" else ~holds).select(*a.columns)
    kept_a, kept_b = a.where(F.col(left).isNotNull()), b.where(F.col(right).isNotNull())
    kind = a.schema[left].dataType if a.schema[left].dataType == b.schema[right].dataType else T.DoubleType()
    one = kept_a.select(F.col(left).cast(kind).alias("__x"), F.lit(0).alias("__side"), F.struct(*a.columns).alias("__a"), F.lit(None).cast(T.StructType(b.schema.fields)).alias("__b"))
    two = kept_b.select(F.col(right).cast(kind).alias("__x"), F.lit(1).alias("__side"), F.lit(None).cast(T.StructType(a.schema.fields)).alias("__a"), F.struct(*b.columns).alias("__b"))
    many = ranges or min(MOST_RANGES, -(-(kept_a.count() + kept_b.count()) // MET_ROWS))
    placed = in_ranges(one.unionByName(two), ["__x"], max(1, many))
    last = max(1, many) - 1
    side_a = placed.where("__side = 0").select("__range", "__a.*")
    reach = F.sequence(F.col("__range"), F.lit(last)) if rising else F.sequence(F.lit(0), F.col("__range"))
    side_b = placed.where("__side = 1").select(F.explode(reach).alias("__range"), "__b.*")
    met = side_a.join(side_b, ["__range", *by])
    pairs = met.where(_TESTS[test](F.col(left), F.col(right))).drop("__range")
    columns = [*a.columns, *(c for c in b.columns if c not in by)]
    if how == "inner":
        return pairs.select(*columns)
    alone = inequality_join(a, b, left, test, right, by, "anti")
    return pairs.select(*columns).unionByName(alone, allowMissingColumns=True)


def inequality_counts(a: DataFrame, b: DataFrame, left: str, test: str, right: str, name: str = "n", ranges: int | None = None) -> DataFrame:
    """``a`` with the number of rows of ``b`` for which ``left test right`` holds, without making the pairs.

    Both sides are one sequence in the order of the values, in which rows of ``b`` are counted; a null value has none.
    """
    if test not in _TESTS:
        raise ValueError(f"{test} is no order")
    kind = a.schema[left].dataType if a.schema[left].dataType == b.schema[right].dataType else T.DoubleType()
    own = F.lit(1 if test in (">=", "<=") else 0)  # whether equal ones of b come before
    one = a.select(F.col(left).cast(kind).alias("__x"), own.alias("__side"), F.lit(0).cast("long").alias("__one"), F.struct(*a.columns).alias("__a"))
    two = b.where(F.col(right).isNotNull()).select(F.col(right).cast(kind).alias("__x"), (1 - own).alias("__side"), F.lit(1).cast("long").alias("__one"), F.lit(None).cast(T.StructType(a.schema.fields)).alias("__a"))
    order = ["__x" if test in (">=", ">") else "-__x", "__side"]
    seen = scanned(one.unionByName(two), order, ranges, __upto=F.col("__one")).where("__one = 0")
    return seen.select("__a.*", F.when(F.col("__x").isNotNull(), F.col("__upto")).otherwise(0).alias(name))


#: Rows of both sides of an inequality join in one range.
MET_ROWS = 500_000
#: Levels of the hierarchy of lengths below that of the whole span.
LEVELS = 40


def _number(df: DataFrame, c: str) -> Column:
    """A number or time as a double."""
    time = isinstance(df.schema[c].dataType, (T.TimestampNTZType, T.DateType))
    return (F.col(c).cast("timestamp") if time else F.col(c)).cast("double")


class Hierarchy:
    """Interval ends of two tables on one scale: an interval is stored at the level of its length, the next
    power of two, where it covers two cells or three; a missing end lies beyond all others."""

    def __init__(self, *tables: tuple[DataFrame, tuple[str, ...]]) -> None:
        found: list[float] = []
        for df, columns in tables:
            finite = [F.when(F.abs(x) < float("inf"), x) for x in (_number(df, c) for c in columns)]
            found += [x for x in df.agg(*(f(x) for x in finite for f in (F.min, F.max))).first() if x is not None]
        low, high = min(found, default=0.0), max(found, default=0.0)
        room = max(high - low, 1e-9 * max(abs(low), abs(high), 1.0)) * 0.001
        self.low, self.high = low - room, high + room
        self.top = math.ceil(math.log2(self.high - self.low))

    def on_scale(self, x: Column) -> Column:
        return F.greatest(F.lit(self.low), F.least(F.lit(self.high), x))

    def ends(self, df: DataFrame, lower: str, upper: str) -> tuple[Column, Column]:
        return self.on_scale(F.coalesce(_number(df, lower), F.lit(self.low))), self.on_scale(F.coalesce(_number(df, upper), F.lit(self.high)))

    def level(self, lower: Column, upper: Column) -> Column:
        exact = F.ceil(F.log2(F.greatest(upper - lower, F.lit(2.0 ** (self.top - LEVELS))))).cast("int")
        return F.greatest(F.lit(self.top - LEVELS), F.least(F.lit(self.top), exact))

    def cell(self, x: Column, level: Column) -> Column:
        return F.floor((x - self.low) / F.pow(F.lit(2.0), level.cast("double"))).cast("long")


def _stored(df: DataFrame, scale: Hierarchy, lower: str, upper: str, prefix: str) -> DataFrame:
    """Intervals with their ends and level; those that end before they begin are none."""
    low, high = scale.ends(df, lower, upper)
    ends = df.withColumns({f"{prefix}low": low, f"{prefix}high": high}).where(F.col(f"{prefix}low") <= F.col(f"{prefix}high"))
    return ends.withColumn(f"{prefix}level", scale.level(F.col(f"{prefix}low"), F.col(f"{prefix}high")))


def _levels(df: DataFrame, level: str) -> list[int]:
    """The levels that a table has; ``LEVELS`` + 1 at most."""
    return sorted(r[0] for r in df.select(level).distinct().collect())


#: Rows of a cell on either side that one part of it takes.
CELL_ROWS = 4096


def _met(probe: DataFrame, stored: DataFrame, scale: Hierarchy, p: str, s: str, levels: Column, by: tuple[str, ...]) -> DataFrame:
    """Pairs that share a cell of the stored side's level, each in the first cell that both cover.

    A cell of many rows is dealt out in parts of both sides, every pair of which meets, so that none is one task.
    """

    def in_cells(df: DataFrame, x: str, first: str) -> DataFrame:
        at = F.col("__level")
        begun = df.withColumn(first, scale.cell(F.col(f"{x}low"), at)).withColumn("__last", scale.cell(F.col(f"{x}high"), at))
        return begun.withColumn("__cell", F.explode(F.sequence(first, "__last"))).drop("__last")

    left = in_cells(probe.withColumn("__level", F.explode(levels)), p, "__p_first")
    right = in_cells(stored.withColumn("__level", F.col(f"{s}level")), s, "__s_first")
    keys = ["__level", "__cell", *by]
    parts = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name))
    crowded = F.broadcast(parts(left, "__left").join(parts(right, "__right"), keys).where("__left > 1 or __right > 1"))  # a row for thousands

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        known = [F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
        number = F.pmod(F.xxhash64(*known), F.coalesce(own, F.lit(1))).cast("int")
        return df.join(crowded, keys, "left").withColumns({f"{own}_part": number, f"{other}_part": F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))}).drop("__left", "__right")

    keys_of_parts = [*keys, "__left_part", "__right_part"]
    tasks = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # Both sides are dealt by number: a side dealt by its bytes, which say nothing of the pairs, would be one task where the other is broadcast.
    met = dealt(left, "__left", "__right").repartition(tasks, *keys_of_parts).join(dealt(right, "__right", "__left").repartition(tasks, *keys_of_parts), keys_of_parts)
    return met.where(F.col("__cell") == F.greatest("__p_first", "__s_first")).drop("__level", "__cell", "__p_first", "__s_first", "__left_part", "__right_part")


def _within(x: Column, lower: str, upper: str, bounds: str) -> Column:
    """Whether a value lies in an interval; a null end is no bound."""
    above = x >= F.col(lower) if bounds[0] == "[" else x > F.col(lower)
    below = x <= F.col(upper) if bounds[1] == "]" else x < F.col(upper)
    return (F.col(lower).isNull() | above) & (F.col(upper).isNull() | below)


def interval_join(points: DataFrame, intervals: DataFrame, point: str, lower: str, upper: str, by: tuple[str, ...] = (), bounds: str = "[]") -> DataFrame:
    """Points within intervals of numbers or times (``between``); an end of an interval may be null, that is open.

    Intervals stand at the level of their length, points ask every level that there is, so no width is
    asked for and a very long interval is stored two or three times.  Null points and null keys meet nothing.
    """
    scale = Hierarchy((points, (point,)), (intervals, (lower, upper)))
    stored = _stored(intervals, scale, lower, upper, "__s_")
    asked = points.where(F.col(point).isNotNull()).withColumns({"__p_low": scale.on_scale(_number(points, point)), "__p_high": scale.on_scale(_number(points, point))})
    levels = _levels(stored, "__s_level")
    met = _met(asked, stored, scale, "__p_", "__s_", F.array(*map(F.lit, levels)).cast("array<int>"), by)
    return met.where(_within(F.col(point), lower, upper, bounds)).drop(*(f"__{x}_{y}" for x in "ps" for y in ("low", "high", "level")))


def overlap_join(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], by: tuple[str, ...] = (), bounds: str = "[]", kind: str = "overlaps") -> DataFrame:
    """Pairs of intervals that share a value, or with ``within`` those of ``a`` that lie in one of ``b``.

    ``bounds`` say whether ends belong to the intervals of both sides; a null end is no bound.  The shorter
    of a pair asks at the level of the longer, so each pair meets once.  Intervals that hold no value meet
    nothing, nor do null keys.
    """
    if kind not in ("overlaps", "within"):
        raise ValueError(f"{kind} is no relation of intervals")
    scale = Hierarchy((a, a_range), (b, b_range))
    left, right = _stored(a, scale, *a_range, "__a_"), _stored(b, scale, *b_range, "__b_")
    if bounds != "[]":
        holds = lambda lower, upper: F.col(lower).isNull() | F.col(upper).isNull() | (F.col(lower) < F.col(upper))
        left, right = left.where(holds(*a_range)), right.where(holds(*b_range))
    above = lambda have, level, equal: F.filter(F.array(*map(F.lit, have)).cast("array<int>"), lambda x: x >= F.col(level) if equal else x > F.col(level))
    met = _met(left, right, scale, "__a_", "__b_", above(_levels(right, "__b_level"), "__a_level", True), by)
    if kind == "overlaps":
        met = met.unionByName(_met(right, left, scale, "__b_", "__a_", above(_levels(left, "__a_level"), "__b_level", False), by))
    free = lambda x, y, test: F.col(x).isNull() | F.col(y).isNull() | test(F.col(x), F.col(y))
    closed = bounds == "[]"
    if kind == "overlaps":
        reach = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
        holds = free(a_range[0], b_range[1], reach) & free(b_range[0], a_range[1], reach)
    else:
        no_end = lambda y, infinite: F.col(y).isNull() | (_number(b, y) == F.lit(infinite))
        no_less = no_end(b_range[0], float("-inf")) | F.coalesce(F.col(a_range[0]) >= F.col(b_range[0]), F.lit(False))
        no_more = no_end(b_range[1], float("inf")) | F.coalesce(F.col(a_range[1]) <= F.col(b_range[1]), F.lit(False))
        holds = no_less & no_more
    columns = [*a.columns, *(c for c in b.columns if c not in by)]
    return met.where(holds).select(*columns)


def grid_lookup(points: DataFrame, grid: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Values of the grid cell that holds a point; cells are keyed by two whole numbers."""
    cell = points.withColumns({"cell_x": F.floor(F.col(x) / size).cast("long"), "cell_y": F.floor(F.col(y) / size).cast("long")})
    return cell.join(grid, ["cell_x", "cell_y"], "left")


def rows_append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def _unlike(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join of ``a`` with the keys of ``b``; null keys meet."""
    side = b.select(*(F.col(f"`{k}`").alias(f"__right_{k}") for k in keys)).distinct()
    return a.join(side, null_safe(keys, [f"__right_{k}" for k in keys]), how)


def rows_insert(a: DataFrame, b: DataFrame, keys: list[str], conflict: str = "error") -> DataFrame:
    """Adds rows of new keys; a key that exists is an error or ignored.  Null is a key."""
    if conflict == "error" and not _unlike(b, a, keys, "left_semi").isEmpty():
        raise ValueError("a key exists already")
    return a.unionByName(_unlike(b, a, keys, "left_anti"), allowMissingColumns=True)


def _one_row_a_key(b: DataFrame, keys: list[str]) -> None:
    if not b.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("the changes repeat a key")


def _all_matched(a: DataFrame, b: DataFrame, keys: list[str], unmatched: str) -> None:
    if unmatched == "error" and not _unlike(b, a, keys, "left_anti").isEmpty():
        raise ValueError("a key of the changes is not in the table")


def _changed(a: DataFrame, b: DataFrame, keys: list[str], value) -> DataFrame:
    """``a`` with values of ``b``, which must have a key once; null keys meet."""
    _one_row_a_key(b, keys)
    new = [c for c in b.columns if c not in keys]
    side = b.select(*(F.col(f"`{k}`").alias(f"__right_{k}") for k in keys), *(F.col(c).alias(f"__new_{c}") for c in new), F.lit(True).alias("__found"))
    joined = a.join(side, null_safe(keys, [f"__right_{k}" for k in keys]), "left")
    return joined.select(*(value(c).alias(c) if c in new else F.col(c) for c in a.columns))


def rows_update(a: DataFrame, b: DataFrame, keys: list[str], unmatched: str = "error") -> DataFrame:
    """Replaces the values of keys in both; a key of ``b`` that ``a`` has not is an error or ignored."""
    _all_matched(a, b, keys, unmatched)
    return _changed(a, b, keys, lambda c: F.when(F.col("__found"), F.col(f"__new_{c}")).otherwise(F.col(c)))


def rows_patch(a: DataFrame, b: DataFrame, keys: list[str], unmatched: str = "error") -> DataFrame:
    """Fills only nulls of keys in both; a key of ``b`` that ``a`` has not is an error or ignored."""
    _all_matched(a, b, keys, unmatched)
    return _changed(a, b, keys, lambda c: F.coalesce(F.col(c), F.col(f"__new_{c}")))


def rows_upsert(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces values of keys in both and adds the others."""
    changed = _changed(a, b, keys, lambda c: F.when(F.col("__found"), F.col(f"__new_{c}")).otherwise(F.col(c)))
    return changed.unionByName(_unlike(b, a, keys, "left_anti"), allowMissingColumns=True)


def rows_delete(a: DataFrame, b: DataFrame, keys: list[str], unmatched: str = "error") -> DataFrame:
    """Rows whose key is not in ``b``; a key of ``b`` that ``a`` has not is an error or ignored."""
    _all_matched(a, b, keys, unmatched)
    return _unlike(a, b, keys, "left_anti")


def pair_wide(df: DataFrame, key: list[str], side: str, sides: tuple[str, str], columns: list[str]) -> DataFrame:
    """Two sides of each key in one row (``<side>_<column>``); a key must have one row of each."""
    pick = lambda s, c: F.max(F.when(F.col(side) == s, F.col(c))).alias(f"{s}_{c}")
    out = df.groupBy(*key).agg(*(pick(s, c) for s in sides for c in columns), *(F.count_if(F.col(side) == s).alias(f"__{s}") for s in sides))
    one = (F.col(f"__{sides[0]}") == 1) & (F.col(f"__{sides[1]}") == 1)
    return out.where(F.when(one, True).otherwise(F.raise_error(F.lit("a key has not one row of each side")).cast("boolean"))).drop(*(f"__{s}" for s in sides))
