"""Diagnostics of long chains against the whole chain at once; chains in segments; weighted samples."""

from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.operators import ordered, stats
from tessera.operators import verbs as V


def plain_size(x):
    n, x = len(x), x - x.mean()
    most = min(n - 1, int(10 * np.log10(n)))
    acov = np.array([x[: n - k] @ x[k:] / n for k in range(most + 1)])
    best, phi, error = (n * np.log(acov[0]), np.zeros(0), acov[0]), np.zeros(0), acov[0]
    for k in range(1, most + 1):
        r = (acov[k] - phi @ acov[1:k][::-1]) / error
        phi = np.append(phi - r * phi[::-1], r)
        error *= 1 - r * r
        if n * np.log(error) + 2 * k < best[0]:
            best = (n * np.log(error) + 2 * k, phi, error)
    _, phi, noise = best
    return n * x.var(ddof=1) / (noise * n / (n - len(phi) - 1) / (1 - phi.sum()) ** 2)


def chains(seed=1, n=1500):
    r = np.random.default_rng(seed)
    out = {}
    for effect in ("a", "b"):
        for chain in (1, 2, 3):
            x = np.zeros(n + 40 * chain)
            for t in range(1, len(x)):
                x[t] = (0.8 if effect == "a" else 0.1) * x[t - 1] + r.normal()
            out[effect, chain] = x + r.normal() * 0.3
    return out


@pytest.mark.parametrize("small", [False, True])
def test_effective_size_and_mpsrf_by_chunks(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(stats, "CHUNK", 100)
        monkeypatch.setattr(ordered, "RANGE_ROWS", 2000)
    made = chains()
    data = [("m", e, c, t + 1, float(v)) for (e, c), x in made.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(data, "model string, effect string, chain int, iter int, value double").repartition(6)
    got = {r.effect: r.ess for r in stats.effective_size(df, ["effect"]).collect()}
    for e in ("a", "b"):
        assert got[e] == pytest.approx(sum(plain_size(made[e, c]) for c in (1, 2, 3)), rel=1e-9)
    n = min(map(len, made.values()))
    groups = [np.array([made[e, c][:n] for e in ("a", "b")]) for c in (1, 2, 3)]
    within = sum(np.cov(g) for g in groups) / 3
    between = np.cov(np.array([g.mean(axis=1) for g in groups]).T)
    want = np.sqrt(1 - 1 / n + 4 / 3 * max(np.linalg.eigvals(np.linalg.solve(within, between)).real))
    found = stats.mpsrf(df, ["model"], "effect")
    assert [r.mpsrf for r in found.collect()] == [pytest.approx(want, rel=1e-9)]
    plan = stats.lagged_products(df, ["effect", "chain"], "iter", "value")._jdf.queryExecution().optimizedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_short_and_constant_chains(spark):
    df = spark.createDataFrame([("c", 1, t, 2.0) for t in range(50)] + [("s", 1, t, float(t)) for t in range(2)] + [("n", 1, 1, None)], "effect string, chain int, iter int, value double")
    assert {r.effect: r.ess for r in stats.effective_size(df, ["effect"]).collect()} == {"c": 0.0, "s": 0.0}


def model(spark, n=150):
    r = np.random.default_rng(4)
    x, g = r.normal(size=n), r.integers(0, 6, n)
    y = (0.2 + 0.9 * x + r.normal(size=n) > 0).astype(int)
    data = spark.createDataFrame([("main", f"g{a}", float(b), int(c)) for a, b, c in zip(g, x, y, strict=True)], "variant string, genus string, z double, is_white int")
    return M.task_manifest(spark, [("main", "p")], [("WHITE", "is_white")], [42, 7]), data


def test_a_killed_run_goes_on_to_the_same_draws(spark, tmp_path):
    manifest, data = model(spark)
    columns = ["task_id", "chain", "effect", "iter", "value"]
    run = lambda name, **more: M.run_segments(manifest, data, "variant", lambda c: c, ["z"], "genus", str(tmp_path / name), 70, 11, 3, segment=20, **more)
    whole = rows(M.fit_chains(manifest, data, "variant", lambda c: c, ["z"], "genus", 70, 11, 3), *columns)
    assert len(whole) == 2 * 3 * 20
    first = run("a", most=2)
    assert first.count() == 2 * 3 * 10  # iterations 11, 14, ... 38
    (tmp_path / "a" / "segment=000001" / "_SUCCESS").unlink()  # killed before its end: made again
    assert rows(run("a"), *columns) == whole
    assert rows(run("a"), *columns) == whole  # nothing is left to do
    early = run("b", until=100.0)
    assert early.select(F.max("iter")).first()[0] < 20


def test_rows_that_are_alike_are_sent_once_and_drawn_each(spark, monkeypatch):
    r = np.random.default_rng(8)
    g, x, y = r.integers(0, 3, 900), r.integers(0, 4, 900) / 2, r.integers(0, 2, 900)
    order = np.lexsort((y, x, g))
    g, x, y = g[order], x[order], y[order]
    distinct, counts = np.unique(np.column_stack([g, x, y]), axis=0, return_counts=True)
    assert len(distinct) == 24
    pair = lambda v: np.column_stack([np.ones(len(v)), v])
    each = M.gibbs(y, pair(x), g, 40, 5, 1, 3)
    for rows_ in (1 << 16, 7, 900):
        monkeypatch.setattr(M, "LATENT_ROWS", rows_)
        some = M.gibbs(distinct[:, 2].astype(int), pair(distinct[:, 1]), distinct[:, 0].astype(int), 40, 5, 1, 3, counts=counts)
        assert some[0] == pytest.approx(each[0], rel=1e-9) and some[1] == pytest.approx(each[1], rel=1e-9)
    data = spark.createDataFrame([("main", f"g{a}", float(b), int(c)) for a, b, c in zip(g, x, y, strict=True)], "variant string, genus string, z double, is_white int").repartition(5)
    manifest = M.task_manifest(spark, [("main", "p")], [("WHITE", "is_white")], [3])
    sent = M._alike(manifest, data, "variant", lambda c: c, ["z"], "genus")
    assert sent.count() == 24 and sent.agg(F.sum("__rows")).first()[0] == 900
    draws = M.fit_chains(manifest, data, "variant", lambda c: c, ["z"], "genus", 40, 5, 1)
    assert [v for (v,) in draws.where("effect = 'z'").orderBy("iter").select("value").collect()] == pytest.approx(each[0][:, 1].tolist(), rel=1e-9)


def test_weighted_sample_rates(spark):
    weights = {k: w for k, w in enumerate([1.0, 1.0, 2.0, 4.0, 8.0, 0.0])}
    rows_ = [(t, k, w) for t in range(2000) for k, w in weights.items()] + [(1, 9, None)]
    df = spark.createDataFrame(rows_, "t int, k int, w double")
    got = V.weighted_sample(df, 1, "w", ["t", "k"], "t")
    drawn = Counter(r.k for r in got.collect())
    assert sum(drawn.values()) == 2000 and not drawn[5] and not drawn[9]
    for k, w in weights.items():
        p = w / 16
        assert abs(drawn[k] - 2000 * p) <= 3 * (2000 * p * (1 - p)) ** 0.5 + 1e-9
    two = V.weighted_sample(df, 2, "w", ["t", "k"], "t", seed=1)
    assert rows(two) == rows(V.weighted_sample(df.repartition(9), 2, "w", ["t", "k"], "t", seed=1)) and two.count() == 4000
    assert V.weighted_sample(df.where("k = 5"), 3, "w", ["t", "k"], "t").count() == 0


@pytest.mark.parametrize("ranges", [1, 5])
def test_replacement_sample_rates(spark, ranges):
    df = spark.createDataFrame([(k, "g" if k % 3 else None, float(k % 4)) for k in range(40)], "k int, g string, w double")
    got = V.replacement_sample(df, 3000, ["k"], by=["g"], ranges=ranges)
    drawn = Counter((r.g, r.k) for r in got.collect())
    for g, size in (("g", 26), (None, 14)):
        own = {k: m for (h, k), m in drawn.items() if h == g}
        assert sum(own.values()) == 3000 and len(own) == size
        assert all(abs(m - 3000 / size) <= 4 * (3000 / size) ** 0.5 for m in own.values())
    weighted = V.replacement_sample(df, 4000, ["k"], "w", ranges=ranges)
    by_weight = Counter(r.w for r in weighted.collect())
    assert sum(by_weight.values()) == 4000 and by_weight[0.0] == 0
    for w in (1.0, 2.0, 3.0):
        assert abs(by_weight[w] - 4000 * w / 6) <= 3 * (4000 * w / 6 * (1 - w / 6)) ** 0.5
    assert rows(got) == rows(V.replacement_sample(df.repartition(7), 3000, ["k"], by=["g"], ranges=ranges))
    assert V.replacement_sample(df.limit(0), 5, ["k"]).count() == 0
