"""Statistics against hand-worked numbers and numpy."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import models as M
from tessera.operators import scoring as S
from tessera.operators import stats


def test_trimmed_mean(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 10.0, 50.0, 60.0)] + [("b", 4.0), ("b", 6.0), ("b", None)], "k string, x double")
    assert rows(stats.trimmed_mean(df, ["k"], ["x"])) == [("a", "x", 16.25), ("b", "x", 5.0)]


def test_trimmed_mean_with_repeated_values_equals_sorting(spark):
    values = np.random.default_rng(0).integers(0, 6, 101).astype(float)
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, x double")
    assert rows(stats.trimmed_mean(df, ["k"], ["x"]))[0][2] == pytest.approx(np.sort(values)[20:81].mean())


def test_bh(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.02), ("f", 0.03), ("f", 0.5), ("f", None)], "f string, p double")
    assert [q for _, _, q in sorted(map(tuple, stats.bh(df, "p", ["f"]).where("p is not null").collect()))] == pytest.approx([0.04, 0.04, 0.04, 0.5])


def test_both_tails(spark):
    from tessera.functions.text import pmcmc_floor

    df = spark.createDataFrame([("m", float(i + 1)) for i in range(10)], "m string, value double")
    assert stats.posterior_quantile(df, ["m"]).first()["pMCMC"] == 0
    assert df.agg(pmcmc_floor(F.avg((F.col("value") > 0).cast("int")), F.count("*"))).first()[0] == pytest.approx(0.1)


def test_hpd_is_the_narrowest(spark):
    x = np.sort(np.random.default_rng(1).exponential(size=200))
    gap = round(0.95 * 200)
    k = int(np.argmin(x[gap:] - x[: 200 - gap]))
    got = stats.posterior_hpd(spark.createDataFrame([("m", float(v)) for v in x], "m string, value double"), ["m"]).first()
    assert (got.lower, got.upper) == (x[k], x[k + gap])


def test_kappa_and_friends(spark):
    df = spark.createDataFrame([("m", "A", "A"), ("m", "A", "B"), ("m", "B", "B"), ("m", "B", "B")], "model string, gold string, pred string")
    cells = S.cells(df, ["model"])
    assert S.kappa(cells, ["model"]).first().kappa == pytest.approx(0.5)
    assert S.accuracy(cells, ["model"]).first().accuracy == 0.75
    f1 = {r["class"]: r.f1 for r in S.by_class(cells, ["model"], ("A", "B", "C")).collect()}
    assert f1 == {"A": pytest.approx(2 / 3), "B": pytest.approx(0.8), "C": 0.0}
    assert S.macro_f1(cells, ["model"], ("A", "B", "C")).first().macro_f1 == pytest.approx((2 / 3 + 0.8) / 2)
    low = S.metric_bootstrap(cells, ["model"], "accuracy", 500, 7).first()
    assert low.low <= 0.75 <= low.high


def test_chi_square_and_its_tail(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5, "g string, c string")
    one = stats.chi_square(df, "g", "c").withColumn("p", stats.chi_square_tail()).first()
    o = np.array([[10, 20], [30, 5]], float)
    e = o.sum(1)[:, None] * o.sum(0)[None] / o.sum()
    assert one.statistic == pytest.approx(((o - e) ** 2 / e).sum()) and one.df == 1
    tail = spark.createDataFrame([(31.246, 8.0), (0.0, 3.0), (3.841459, 1.0)], "statistic double, df double").select(stats.chi_square_tail()).collect()
    assert [r[0] for r in tail] == pytest.approx([1.27e-4, 1.0, 0.05], rel=1e-2)


def test_psrf_against_numpy(spark):
    draws = np.random.default_rng(2).normal(size=(3, 50)) + np.array([[0.0], [0.3], [-0.2]])
    df = spark.createDataFrame([("m", c, i, float(draws[c, i])) for c in range(3) for i in range(50)], "m string, chain int, iter int, value double")
    m, n = draws.shape
    w, means, s2 = draws.var(axis=1, ddof=1).mean(), draws.mean(axis=1), draws.var(axis=1, ddof=1)
    b = n * means.var(ddof=1)
    v = (n - 1) / n * w + (1 + 1 / m) * b / n
    cov = lambda a, c: np.cov(a, c)[0, 1]
    vv = ((n - 1) / n) ** 2 * s2.var(ddof=1) / m + ((m + 1) / (m * n)) ** 2 * 2 / (m - 1) * b**2 + 2 * (m + 1) * (n - 1) / (m * n**2) * n / m * (cov(s2, means**2) - 2 * means.mean() * cov(s2, means))
    d = 2 * v**2 / vv
    assert stats.psrf(df, ["m"]).first().psrf == pytest.approx(np.sqrt((d + 3) / (d + 1) * v / w))
    assert stats.mpsrf(df.withColumn("p", F.lit("x")), ["m"], "p").first().mpsrf == pytest.approx(np.sqrt((1 - 1 / n) + (1 + 1 / m) * b / n / w))


def test_effective_size_of_independent_and_sticky_draws(spark):
    r = np.random.default_rng(3)
    free, sticky = r.normal(size=1000), np.zeros(1000)
    for i in range(1, 1000):
        sticky[i] = 0.9 * sticky[i - 1] + r.normal()
    df = spark.createDataFrame([(n, 1, i, float(v)) for n, x in (("free", free), ("sticky", sticky)) for i, v in enumerate(x)], "m string, chain int, iter int, value double")
    got = dict(map(tuple, stats.effective_size(df, ["m"]).collect()))
    assert 800 < got["free"] < 1300 and 25 < got["sticky"] < 110


def test_thin_keeps_ends(spark):
    df = spark.createDataFrame([("k", i) for i in range(1, 1001)], "k string, i int")
    kept = [r.i for r in stats.thin(df, ["k"], "i", 10).orderBy("i").collect()]
    assert kept == sorted({int(np.rint(1 + j * 999 / 9)) for j in range(10)})


def test_components_are_those_of_the_correlation_matrix(spark):
    x = np.random.default_rng(4).normal(size=(200, 3)) @ np.array([[1, 0.8, 0], [0, 1, 0.3], [0, 0, 1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    loadings = M.Components(df, ["a", "b", "c"], 2).loadings
    _, vectors = np.linalg.eigh(np.corrcoef(x.T))
    top = vectors[:, ::-1][:, :2]
    top *= np.sign(top[np.abs(top).argmax(axis=0), [0, 1]])
    assert loadings == pytest.approx(top, abs=1e-8)


def test_gibbs_finds_the_effect():
    r = np.random.default_rng(5)
    x, g = r.normal(size=400), r.integers(0, 10, 400)
    y = (0.3 + 1.2 * x + r.normal(size=400) > 0).astype(int)
    betas, variances = M.gibbs(y, np.column_stack([np.ones(400), x]), g, 600, 100, 1, 1)
    assert abs(betas[:, 1].mean() - 1.2) < 0.35 and (variances > 0).all() and len(betas) == 500


def test_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(i, f"g{i % 13}", "ab"[i % 2]) for i in range(130)], "i int, g string, c string")
    f = M.grouped_folds(df, "g", "c", 5)
    assert f.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    assert f.select("fold").distinct().count() == 5


def test_audit_states(spark):
    a = A.Audit(spark)
    one = spark.createDataFrame([(0.5001, None)], "x double, y double")
    a.equal("s", "near", one, "x", 0.5)
    a.equal("s", "far", one, "x", 0.6)
    a.equal("s", "null", one, "y", 0.6)
    a.pending("s", "absent")
    assert sorted(r.status for r in a.table().collect()) == ["FAIL", "PASS", "PEND", "PEND"]
    assert A.exit_code(a.table()) == 1
    with pytest.raises(Exception, match="is null"):
        A.stop_on_null(one, "y").collect()


def brute_group_folds(rows, k):
    """Equal vectors dealt round, the others one by one; on plain lists."""
    classes = sorted({c for _, c in rows}, key=lambda c: (c is not None, c or ""))
    vectors = {}
    for g, c in rows:
        vectors.setdefault(g, [0] * len(classes))[classes.index(c)] += 1
    kinds = {}
    for g in sorted(vectors, key=lambda g: (g is None, g)):
        kinds.setdefault(tuple(vectors[g]), []).append(g)
    folds, rest = {}, []
    for v, own in kinds.items():
        even = len(own) - len(own) % k
        folds |= {g: n % k for n, g in enumerate(own[:even])}
        rest += [(-sum(v), g is None, g, v) for g in own[even:]]
    total = [max(1, sum(r[3][c] for r in rest)) for c in range(len(classes))]
    held = [[0] * len(classes) for _ in range(k)]
    for _, _, g, v in sorted(rest, key=lambda r: r[:2] + (r[2] or "",)):
        cost = [(round(sum(h[c] * v[c] / total[c] ** 2 for c in range(len(classes))), 12), sum(h), f) for f, h in enumerate(held)]
        fold = min(cost)[2]
        held[fold] = [a + b for a, b in zip(held[fold], v, strict=True)]
        folds[g] = fold
    return folds


def test_balanced_group_folds_equal_brute_force_and_spread_classes(spark):
    r = np.random.default_rng(8)
    rows = [(f"g{g:03}", "abc"[min(2, int(r.exponential(0.8)))]) for g in range(160) for _ in range(int(r.exponential(4)) + 1)] + [("g000", "a")] * 60 + [(None, "b"), ("g001", None)]
    df = spark.createDataFrame(rows, "g string, c string")
    got = M.stratified_group_folds(df, "g", "c", 5)
    assert got.count() == len(rows)
    folds = {x.g: x.fold for x in got.select("g", "fold").distinct().collect()}
    assert folds == brute_group_folds(rows, 5)
    spread = {x.c: (x.n, x.least, x.most) for x in M.fold_deviation(got, "c").collect()}
    assert all(spread[c][2] - spread[c][1] <= 0.05 * spread[c][0] + 2 for c in "bc") and spread[None] == (1, 0, 1)
    # In parts of few groups, level by level: groups stay whole and classes even.
    parts = M.stratified_group_folds(df, "g", "c", 5, balanced=30)
    assert parts.count() == len(rows) and parts.select("g", "fold").distinct().count() == len(folds)
    spread = {x.c: (x.n, x.least, x.most) for x in M.fold_deviation(parts, "c").collect()}
    assert all(spread[c][2] - spread[c][1] <= 0.08 * spread[c][0] + 2 for c in "bc")
    assert M.stratified_group_folds(df.limit(0), "g", "c").count() == 0


def test_group_folds_in_ranges_equal_those_of_one_task(spark):
    r = np.random.default_rng(9)
    rows = [(f"g{g:03}", "abcde"[r.integers(5)]) for g in range(150) for _ in range(int(r.exponential(6)) + 1)] + [(None, "b"), ("g001", None)]
    df = spark.createDataFrame(rows, "g string, c string")
    assert {x.g: x.fold for x in M.stratified_group_folds(df, "g", "c", 5, balanced=25).select("g", "fold").distinct().collect()} == brute_group_folds(rows, 5)
