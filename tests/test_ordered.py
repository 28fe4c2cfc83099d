"""Whole-table numbers, ranks, sums and quantiles against sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered as R
from tessera.operators import quantiles as Q
from tessera.operators import verbs as V


def table(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), None if r.random() < 0.1 else float(r.randrange(12)), r.randrange(1000)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, g string, x double, m long").repartition(7)


def key(x, down=False):
    return (x is None, 0 if x is None else -x if down else x)


@pytest.mark.parametrize("ranges", [1, 2, 9])
def test_numbers_sums_and_buckets(spark, ranges):
    rows, df = table(spark)
    order = sorted(rows, key=lambda r: (key(r[2], True), r[0]))
    got = {r.id: r for r in R.scanned(df, ["-x", "id"], ranges, n=None, total=F.col("m")).collect()}
    total = 0
    for k, r in enumerate(order):
        total += r[3]
        assert (got[r[0]].n, got[r[0]].total) == (k + 1, total)
    buckets = {r.id: r.b for r in R.ntile(df, ["-x", "id"], 7, "b", ranges).collect()}
    sizes = [400 // 7 + (k < 400 % 7) for k in range(7)]
    want = [k + 1 for k, size in enumerate(sizes) for _ in range(size)]
    assert [buckets[r[0]] for r in order] == want


@pytest.mark.parametrize("ranges", [1, 5])
def test_ranks_and_numbers_within_keys(spark, ranges):
    rows, df = table(spark)
    values = sorted(rows, key=lambda r: key(r[2]))
    got = {r.id: r for r in R.ranks(df, ["x"], "least", "dense", "percent", "share", ranges).collect()}
    distinct = sorted({key(r[2]) for r in rows})
    for r in rows:
        below = sum(key(o[2]) < key(r[2]) for o in values)
        upto = sum(key(o[2]) <= key(r[2]) for o in values)
        assert (got[r[0]].least, got[r[0]].dense) == (below + 1, distinct.index(key(r[2])) + 1)
        assert got[r[0]].percent == pytest.approx(below / 399) and got[r[0]].share == pytest.approx(upto / 400)
    within = {r.id: r.k for r in R.row_number_within(df, ["g"], ["x", "id"], "k", ranges).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (key(r[2]), r[0]))
        assert [within[r[0]] for r in own] == list(range(1, len(own) + 1))
    ids = {r.g: r.group_id for r in V.group_ids(df, "g").select("g", "group_id").distinct().collect()}
    assert ids == {"a": 1, "b": 2, None: 3}


def test_a_key_of_nearly_all_rows_is_many_ranges_and_no_window_is_whole(spark, monkeypatch):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("g"))
    monkeypatch.setattr(R, "RANGE_ROWS", 500)
    out = R.row_number_within(df, ["g"], ["id"])
    assert sorted(r[0] for r in out.where("g = 'hot'").select("row_number").collect()) == list(range(1, 4901))
    for made in (R.row_number(df, ["id"]), R.ntile(df, ["id"], 3), R.ranks(df, ["g", "id"], dense_rank="d")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window " in line]
        assert windows and all("__range" in line.split("], [")[1] for line in windows), plan
    sizes = R.in_ranges(df, ["g", "id"]).groupBy("__range").count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 1200


def test_empty_and_one_row(spark):
    none = spark.createDataFrame([], "id int, x double")
    assert R.row_number(none, ["id"]).count() == R.ranks(none, ["x"], "r").count() == R.ntile(none, ["id"], 3).count() == 0
    assert R.row_number(spark.createDataFrame([(1, None)], "id int, x double"), ["x"], ranges=4).first()["row_number"] == 1


PROBABILITIES = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("few", [None, 20])
def test_quantiles_equal_numpy(spark, few):
    r = np.random.default_rng(5)
    groups = {"normal": r.normal(size=700), "tail": np.exp(r.normal(size=500) * 8), "two": np.array([1.0] * 150 + [2.0] * 150), "same": np.full(200, 7.0), "ties": r.integers(0, 5, 333).astype(float), "one": np.array([3.5]), None: r.normal(size=90), "far": np.array([1e300, -1e300, 0.0] * 30)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("nulls", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x.g: x.q for x in Q.exact_quantiles(df, ["g"], "x", PROBABILITIES, few).collect()}
    assert set(got) == {*groups, "nulls"} and got["nulls"] is None
    for g, v in groups.items():
        assert got[g] == pytest.approx(np.quantile(v, PROBABILITIES).tolist(), rel=1e-12), g
    spark_own = {x.g: x.q for x in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, PROBABILITIES))).alias("q")).collect()}
    assert {g: q for g, q in got.items() if q} == {g: q for g, q in spark_own.items() if q}


def test_quantiles_of_an_empty_table(spark):
    assert Q.exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", [0.5]).count() == 0
