"""Range joins against all pairs, in one range and in many."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.operators import joins as J

INF = float("inf")


def sides(spark, seed=1, n=60):
    r = random.Random(seed)
    a = [(i, r.choice(["p", "p", "p", "q", None]), r.choice([None, *range(15)])) for i in range(n)]
    b = [(i, r.choice(["p", "p", "q", None]), r.choice([None, *range(15)]), r.choice([None, 1, 2, 3])) for i in range(n)]
    return a, b, spark.createDataFrame(a, "i int, k string, t int"), spark.createDataFrame(b, "j int, k string, u int, tie int")


@pytest.mark.parametrize("ranges", [1, 6])
@pytest.mark.parametrize("closest", [">=", ">", "<=", "<"])
def test_asof_with_a_hot_key_in_many_ranges(spark, ranges, closest):
    a, b, left, right = sides(spark, 2)
    holds = {">=": lambda t, u: t >= u, ">": lambda t, u: t > u, "<=": lambda t, u: t <= u, "<": lambda t, u: t < u}[closest]
    got = rows(J.asof_join(left, right.withColumnRenamed("k", "k"), ["k"], "t", "u", ["u", "tie"], "tie", closest, ranges).na.fill(-1), "i", "u", "tie")
    want = []
    for i, k, t in a:
        near = [(u, -1 if tie is None else tie) for _, l, u, tie in b if l == k and u is not None and t is not None and holds(t, u)]
        want.append((i, *(((max if closest[0] == ">" else min)(near)) if near else (-1, -1))))
    assert got == sorted(want)


@pytest.mark.parametrize("ranges", [1, 5])
@pytest.mark.parametrize("test", [">=", ">", "<=", "<"])
def test_inequality_join(spark, ranges, test):
    a, b, left, right = sides(spark, 3)
    holds = lambda t, u: t is not None and u is not None and {">=": t >= u, ">": t > u, "<=": t <= u, "<": t < u}[test]
    right = right.withColumnRenamed("k", "kk")
    assert rows(J.inequality_join(left, right, "t", test, "u", ranges=ranges), "i", "j") == sorted((i, j) for i, _, t in a for j, _, u, _ in b if holds(t, u))
    keyed = right.withColumnRenamed("kk", "k")
    want = sorted((i, j) for i, k, t in a for j, l, u, _ in b if k is not None and k == l and holds(t, u))
    assert rows(J.inequality_join(left, keyed, "t", test, "u", ("k",), ranges=ranges), "i", "j") == want
    met = {i for i, _ in want}
    assert [r[0] for r in rows(J.inequality_join(left, keyed, "t", test, "u", ("k",), "semi"), "i")] == sorted(met)
    assert [r[0] for r in rows(J.inequality_join(left, keyed, "t", test, "u", ("k",), "anti"), "i")] == sorted({i for i, _, _ in a} - met)
    every = J.inequality_join(left, keyed, "t", test, "u", ("k",), "left", ranges)
    assert every.count() == len(want) + len(a) - len(met) and every.columns == ["i", "k", "t", "j", "u", "tie"]


def test_plans_have_no_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(J, "MET_ROWS", 20)
    _, _, left, right = sides(spark, 4)
    for made in (J.inequality_join(left, right.drop("k"), "t", ">", "u"), J.asof_join(left, right, ["k"], "t", "u", ["u"], "tie", ranges=4)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def spans(r, n):
    out = []
    for i in range(n):
        lo = r.choice([None, r.uniform(-50, 50), float(r.randrange(-5, 5))])
        length = r.choice([0.0, 0.001, 1.0, 7.0, 1000.0, -1.0])
        out.append((i, r.choice(["p", "q"]), lo, r.choice([None, (lo or 0.0) + length, (lo or 0.0) + length])))
    return out


@pytest.mark.parametrize("bounds", ["[]", "[)", "(]", "()"])
def test_intervals_of_all_lengths_and_open_ends(spark, bounds):
    r = random.Random(5)
    a, b = spans(r, 70), spans(r, 70) + [(100, "p", -INF, 3.0), (101, "q", 2.0, INF)]
    left, right = spark.createDataFrame(a, "i int, k string, lo double, hi double"), spark.createDataFrame(b, "j int, k string, low double, high double")
    end = lambda x, none: none if x is None else x
    holds = lambda lo, hi: (lo < hi or (bounds == "[]" and lo == hi)) if lo not in (None,) else True
    full = lambda rows: [(i, k, end(lo, -INF), end(hi, INF)) for i, k, lo, hi in rows if holds(end(lo, -INF), end(hi, INF))]
    reach = (lambda x, y: x <= y) if bounds == "[]" else (lambda x, y: x < y)
    share = lambda x, y: reach(x[2], y[3]) and reach(y[2], x[3])
    want = sorted((x[0], y[0]) for x in full(a) for y in full(b) if x[1] == y[1] and share(x, y))
    assert rows(J.overlap_join(left, right, ("lo", "hi"), ("low", "high"), ("k",), bounds), "i", "j") == want
    want = sorted((x[0], y[0]) for x in full(a) for y in full(b) if y[2] <= x[2] and x[3] <= y[3])
    assert rows(J.overlap_join(left, right.drop("k"), ("lo", "hi"), ("low", "high"), bounds=bounds, kind="within"), "i", "j") == want
    above = (lambda x, y: x >= y) if bounds[0] == "[" else (lambda x, y: x > y)
    below = (lambda x, y: x <= y) if bounds[1] == "]" else (lambda x, y: x < y)
    want = sorted((x[0], y[0]) for x in a if x[2] is not None for y in b if (y[2] is None or above(x[2], y[2])) and (y[3] is None or below(x[2], y[3])))
    assert rows(J.interval_join(left.select("i", "lo"), right.drop("k"), "lo", "low", "high", bounds=bounds), "i", "j") == want


def test_times_and_empty_tables(spark):
    points = spark.sql("SELECT 1 AS i, timestamp_ntz'2024-01-01 10:00:00' AS t UNION ALL SELECT 2, timestamp_ntz'2024-03-01 00:00:00'")
    times = spark.sql("SELECT 7 AS j, timestamp_ntz'2024-01-01 00:00:00' AS low, timestamp_ntz'2024-01-01 10:00:00' AS high UNION ALL SELECT 8, timestamp_ntz'2024-02-01 00:00:00', NULL")
    assert rows(J.interval_join(points, times, "t", "low", "high"), "i", "j") == [(1, 7), (2, 8)]
    assert J.interval_join(points.limit(0), times, "t", "low", "high").count() == J.interval_join(points, times.limit(0), "t", "low", "high").count() == 0
    _, _, left, right = sides(spark)
    assert J.inequality_join(left.limit(0), right.drop("k"), "t", ">", "u").count() == J.asof_join(left.limit(0), right, ["k"], "t", "u", ["tie"], "tie").count() == 0


@pytest.mark.parametrize("test", [">=", ">", "<=", "<"])
@pytest.mark.parametrize("ranges", [1, 5])
def test_counts_of_an_inequality_equal_those_of_its_pairs(spark, test, ranges):
    r = random.Random(11)
    left = [(i, None if i % 9 == 0 else r.randrange(30)) for i in range(120)]
    right = [(None if j % 7 == 0 else r.randrange(30),) for j in range(90)]
    a, b = spark.createDataFrame(left, "i int, x int"), spark.createDataFrame(right, "y int")
    holds = {">=": lambda x, y: x >= y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, "<": lambda x, y: x < y}[test]
    want = sorted((i, sum(holds(x, y) for (y,) in right if y is not None) if x is not None else 0) for i, x in left)
    assert rows(J.inequality_counts(a, b, "x", test, "y", ranges=ranges), "i", "n") == want


def test_a_crowded_cell_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(J, "CELL_ROWS", 8)
    left = [(i, None if i % 3 else float(i % 50), float(60 + i % 5)) for i in range(300)]  # open ends: all in the cells of the greatest length
    right = [(j, float(j % 60), float(j % 60 + 2)) for j in range(200)]
    a, b = spark.createDataFrame(left, "i int, lo double, hi double"), spark.createDataFrame(right, "j int, low double, high double")
    want = sorted((i, j) for i, lo, hi in left for j, low, high in right if (lo is None or lo <= high) and low <= hi)
    met = J.overlap_join(a, b, ("lo", "hi"), ("low", "high")).select("i", "j")
    assert rows(met, "i", "j") == want
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    per_task = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(per_task) >= 4 and max(per_task) < 0.6 * len(want)


@pytest.mark.parametrize("small", ["left", "right"])
def test_a_small_side_leaves_the_other_dealt_out(spark, monkeypatch, small):
    monkeypatch.setattr(J, "CELL_ROWS", 64)
    points, intervals = (30, 4000) if small == "left" else (4000, 30)
    a = spark.range(points).select(F.col("id").alias("p"), (F.col("id") % 50).cast("double").alias("x"))
    b = spark.range(intervals).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, (F.col("id") % 40).cast("double")).alias("lo"), F.lit(None).cast("double").alias("hi"))
    met = J.interval_join(a, b, "x", "lo", "hi").select("p", "i")
    want = sum(i % 3 > 0 or p % 50 >= i % 40 for p in range(points) for i in range(intervals))
    per_task = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per_task) == want and len(per_task) == 4 and max(per_task) < 0.6 * want
    assert met._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2  # else bytes decide on the tasks of one side
