"""Exact quantiles of groups of any size, by selection instead of sorting.

A wanted order statistic is bracketed by two values again and again: approximate percentiles of what lies
between them (a sketch of bounded size, merged from all tasks) guess two closer ones, and exact counts say
whether the statistic lies below, at, between or above these.  When at most ``FEW`` rows are left between, their distinct values are
counted and the statistic is read off.  No group's values ever meet in one task, nor are they sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.operators.joins import null_safe
from tessera.operators.verbs import join_groups

#: Rows of a bracket whose distinct values are counted in one window; cells of a sketch and its accuracy.
FEW, CELLS, ACCURACY = 200_000, 50, 5000
#: Brackets that are sent to all tasks.
BROADCAST_BRACKETS = 50_000


def _inside(rows: DataFrame, state: DataFrame, by: list[str], few: bool) -> DataFrame:
    """Rows with each of their group's brackets that they lie in; bounds are outside, a null one is none."""
    met = rows.join(F.broadcast(state) if few else state, null_safe(by, [f"__s_{c}" for c in by]))
    return met.where((F.col("__low").isNull() | (F.col("__v") > F.col("__low"))) & (F.col("__high").isNull() | (F.col("__v") < F.col("__high"))))


def _narrowed(rows: DataFrame, open_: DataFrame, by: list[str], own: list[str], few: bool) -> DataFrame:
    """The open brackets after a guess of two values within each, and exact counts around them."""
    grid = F.percentile_approx("__v", F.array(*(F.lit(k / CELLS) for k in range(CELLS + 1))), F.lit(ACCURACY))
    sketched = _inside(rows, open_, by, few).groupBy(*open_.columns).agg(grid.alias("g"))
    place = F.col("__rank") - F.col("__below")
    cell = F.floor(place / F.col("__many") * CELLS).cast("int")
    near = sketched.withColumns({"__a": F.get("g", F.greatest(cell - 1, F.lit(0))), "__b": F.get("g", F.least(cell + 2, F.lit(CELLS)))}).drop("g")
    v, low, high = F.col("__v"), F.col("__a"), F.col("__b")
    counted = _inside(rows, near, by, few).groupBy(*near.columns).agg(F.count_if(v < low).alias("n1"), F.count_if(v <= low).alias("n2"), F.count_if(v < high).alias("n3"), F.count_if(v <= high).alias("n4"))
    # The statistic lies below the first value, is it, lies between, is the second, or lies above.
    cases = [place < F.col("n1"), place < F.col("n2"), place < F.col("n3"), place < F.col("n4")]

    def pick(*values):
        out = F.when(cases[0], values[0])
        for case, value in zip(cases[1:], values[1:4], strict=True):
            out = out.when(case, value)
        return out.otherwise(values[4])

    nothing, below, many = F.lit(None).cast("double"), F.col("__below"), F.col("__many")
    return counted.select(
        *own,
        "__rank",
        pick(F.col("__low"), nothing, low, nothing, high).alias("__low"),
        pick(low, nothing, high, nothing, F.col("__high")).alias("__high"),
        pick(below, below, below + F.col("n2"), below, below + F.col("n4")).alias("__below"),
        pick(F.col("n1"), many, F.col("n3") - F.col("n2"), many, many - F.col("n4")).alias("__many"),
        pick(nothing, low, nothing, high, nothing).alias("__found"),
    )


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], few: int | None = None) -> DataFrame:
    """(by, q): the quantiles of each group as an array, linear between order statistics, nulls aside.

    A group of nulls alone has a null array; null keys are a group.  ``few``: ``FEW`` unless given.
    """
    most = few or FEW
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    at = lambda p: F.lit(p) * (F.col("__n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(p)), F.ceil(at(p))) for p in probabilities))))
    nothing = F.lit(None).cast("double")
    own = [f"__s_{c}" for c in by]
    # A bracket: the order statistic wanted (from 0), the values around it, rows up to the lower one, rows between.
    state = sizes.select(*(F.col(c).alias(k) for c, k in zip(by, own, strict=True)), F.explode(ranks).alias("__rank"), nothing.alias("__low"), nothing.alias("__high"), F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__many"), nothing.alias("__found"))
    while True:
        few_brackets = state.count() <= BROADCAST_BRACKETS
        # Cut from what made it: the next round reads it several times.
        state = df.sparkSession.createDataFrame(state.toArrow(), state.schema) if few_brackets else state.persist()
        wide = F.col("__found").isNull() & (F.col("__many") > most)
        if state.where(wide).isEmpty():
            break
        state = state.where(~wide).unionByName(_narrowed(rows, state.where(wide).drop("__found"), by, own, few_brackets))
    values = _inside(rows, state.where("__found IS NULL"), by, few_brackets).groupBy(*own, "__rank", "__below", "__v").agg(F.count("*").alias("__m"))
    w = W.Window.partitionBy(*own, "__rank").orderBy("__v").rowsBetween(W.Window.unboundedPreceding, 0)
    upto = values.withColumn("__upto", F.col("__below") + F.sum("__m").over(w))
    read = upto.where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__m"))).select(*own, "__rank", "__v")
    found = read.unionByName(state.where("__found IS NOT NULL").select(*own, "__rank", F.col("__found").alias("__v")))
    table = found.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))
    known = join_groups(sizes, table.select(*(F.col(k).alias(c) for k, c in zip(own, by, strict=True)), "__at"), by)

    def one(p: float) -> Column:
        low, high = F.floor(at(p)), F.ceil(at(p))
        a, b = F.element_at("__at", low), F.element_at("__at", high)
        return F.when(low == high, a).otherwise((high - at(p)) * a + (at(p) - low) * b)

    quantiles = known.select(*by, F.array(*map(one, probabilities)).alias("q"))
    return join_groups(df.select(*by).distinct(), quantiles, by, "left")
