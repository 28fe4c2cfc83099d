"""Plot statistics against plain formulas."""

from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graphics as G


def data(spark, n=300):
    r = np.random.default_rng(2)
    rows = [(k, ["a", "b", None][k % 3], float(np.round(r.normal(50, 12), 1)), float(r.uniform(0, 30))) for k in range(n)] + [(n, "a", None, 1.0)]
    return rows, spark.createDataFrame(rows, "k int, g string, x double, y double")


def test_normal_quantile(spark):
    ps = [1e-9, 1e-4, 0.02, 0.03, 0.3, 0.5, 0.77, 0.98, 0.9999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(F.expr(G.normal_quantile_sql("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=2e-9, abs=1e-9)


@pytest.mark.parametrize("ranges", [1, 4])
def test_ecdf_and_qq(spark, ranges):
    rows, df = data(spark)
    got = {(r.g, r.x): r.ecdf for r in G.ecdf(df, ["g"], "x", ranges).collect()}
    qq = {r.k: r.theoretical for r in G.qq_normal(df, ["g"], "x", ["k"], ranges).collect()}
    for g in ("a", "b", None):
        own = sorted((x, k) for k, h, x, _ in rows if h == g and x is not None)
        for i, (x, k) in enumerate(own):
            assert got[g, x] == pytest.approx(sum(v <= x for v, _ in own) / len(own))
            assert qq[k] == pytest.approx(NormalDist().inv_cdf((i + 0.5) / len(own)), abs=1e-8)
    assert G.ecdf(df, [], "x", ranges).agg(F.max("ecdf")).first()[0] == 1.0


def test_density_and_smooth(spark):
    rows, df = data(spark)
    dens = [(r.x, r.density) for r in G.density(df, ["g"], "x", 0.0, 100.0).where("g = 'a'").orderBy("x").collect()]
    own = np.array([x for _, g, x, _ in rows if g == "a" and x is not None and 0 <= x <= 100])
    centres = (np.minimum(1024, np.floor(own / 100 * 1024) + 1) - 0.5) * 100 / 1024
    h = 0.9 * centres.std(ddof=1) * len(own) ** -0.2
    want = [np.exp(-0.5 * ((x - centres) / h) ** 2).sum() / (len(own) * h * np.sqrt(2 * np.pi)) for x, _ in dens]
    assert [y for _, y in dens] == pytest.approx(want, rel=1e-9)
    line = df.where("x IS NOT NULL").select("x", (3 + 2 * F.col("x")).alias("z"))
    fitted = G.smooth(line, [], "x", "z", 0.0, 100.0, 20.0).where("x BETWEEN 30 AND 70").collect()
    assert fitted and all(r.fitted == pytest.approx(3 + 2 * r.x, rel=1e-9) for r in fitted)
    assert G.smooth(line, [], "x", "z", 0.0, 100.0, 0.01).where("fitted IS NULL").count() > 0


def test_planes(spark):
    rows, df = data(spark)
    points = [(x, y) for _, _, x, y in rows if x is not None]
    squares = Counter((int(x // 5), int(y // 4)) for x, y in points)
    assert {(r.column, r.row): r.n for r in G.bin_2d(df, [], "x", "y", 5.0, 4.0).collect()} == squares
    w, h = 6.0, 6.0 * 3**0.5
    got = {(round(r.hex_x, 6), round(r.hex_y, 6)): r.n for r in G.bin_hex(df, [], "x", "y", w, h).collect()}
    assert sum(got.values()) == len(points)
    near = Counter()
    for x, y in points:
        centres = [(i * w + o * w / 2, j * h + o * h / 2) for i in range(int(x // w) - 1, int(x // w) + 3) for j in range(int(y // h) - 1, int(y // h) + 3) for o in (0, 1)]
        best = min(centres, key=lambda c: (c[0] - x) ** 2 + (c[1] - y) ** 2)
        near[round(best[0], 6), round(best[1], 6)] += 1
    assert got == near  # each row is at its nearest centre


def test_keys_may_have_any_name(spark):
    rows = [("p", float(k % 7), float(k)) for k in range(40)]
    for name in ("m", "n", "bin", "s1", "h", "w", "u", "k"):
        df = spark.createDataFrame(rows, f"{name} string, value double, other double")
        assert G.density(df, [name], "value", 0.0, 10.0, points=3).columns == [name, "x", "density"]
        assert G.smooth(df, [name], "value", "other", 0.0, 10.0, 5.0, points=3).columns == [name, "x", "fitted"]
        assert G.ecdf(df, [name], "value").columns == [name, "value", "ecdf"]
