"""Hard negatives against brute force over every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H
from tessera.llm import queries

SCHEMA = "vec_id long, label string, embedding array<double>, rank string, row string"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    usable = [(i, x, [int(np.floor(256 * c)) for c in v]) for i, x, v in rows if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    usable = [r for r in usable if sum(c * c for c in r[2]) < 2**62]
    out = []
    for i, x, a in usable:
        if not is_anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(a, b, strict=True)), j, y) for j, y, b in usable if j != i and len(b) == len(a)]
        for s, j, _ in sorted(r for r in scored if r[2] == x)[:positives]:
            inside = sorted((t, k) for t, k, y in scored if y != x and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(inside)]
    return sorted(out)


def found(spark, rows, every=10):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    out = H.mine(df, F.col("vec_id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def vectors(seed, n, dim=9, labels=3, wide=1.0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(4, dim))
    return [(k, str(r.integers(labels)), (wide * (centre[r.integers(4)] + 0.5 * r.normal(size=dim))).tolist()) for k in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force_in_one_cell_and_in_many(spark, monkeypatch, small):
    if small:
        for name, value in {"ROW_BLOCK": 40, "ANCHOR_BLOCK": 5, "TOGETHER": 3, "SAMPLE_VALUES": 300, "BROADCAST_LABELS": 0}.items():
            monkeypatch.setattr(H, name, value)
    rows = vectors(1, 260)
    rows += [(1000 + k, x, v) for k, (_, x, v) in enumerate(rows[:40])]  # copies: ties of scores
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0) != []


def test_a_label_with_nearly_all_rows_and_a_label_of_its_own_for_each(spark, monkeypatch):
    monkeypatch.setattr(H, "ROW_BLOCK", 50)
    rows = [(k, "hot" if k % 20 else f"own {k}", v) for k, _, v in vectors(2, 300)]
    assert found(spark, rows, 4) == brute(rows, lambda i: i % 4 == 0)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(3, 60)
    rows += [(100, None, [1.0] * 9), (110, "1", None), (120, "1", [1.0] * 8 + [nan]), (130, "1", [1.0] * 8 + [inf]), (140, "1", [1.0] * 8 + [None]), (None, "1", [1.0] * 9), (150, "1", [1.0, 2.0]), (151, "1", [1.0, 1.0]), (152, "2", [0.5, 1.0]), (160, "1", [])]
    rows += [(170, "1", [1e300] * 9), (180, "1", [1e6] * 9), (181, "1", [-1e6] * 9), (182, "2", [8e5] * 9), (190, "0", [0.0] * 9), rows[10], rows[10], (20, "2", rows[21][2])]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert found(spark, []) == [] and found(spark, rows, 7777777) == brute(rows, lambda i: i % 7777777 == 0)


def test_bounds_hold_and_filter():
    r = np.random.default_rng(7)
    q = np.floor(256 * r.normal(size=(4000, 64)) / 8)
    codes = H.Codes(list(q[:1500]))
    import pyarrow as pa

    coded, slack = codes.encode(q)
    rows = pa.table({"id": np.arange(4000), "slack": slack, "q": [x.astype(np.int32).tobytes() for x in q], "codes": [x.tobytes() for x in coded]})
    anchors = pa.table({"id": np.arange(100), "row": np.arange(100), "q": [x.astype(np.int32).tobytes() for x in q[:100]]})
    cell = H.Cell(rows, anchors, 64, codes.of(64))
    true = q @ q[:100].T
    for own, lower, upper in cell.bounds():
        assert (lower <= true[:, own]).all() and (true[:, own] <= upper).all()
        assert ((upper - lower) / 2 < 0.25 * np.abs(true[:, own]).max()).all()  # few rows are asked for exactly


def test_query_turns_labels(spark, tmp_path):
    rows = [(i, int(x), v) for i, x, v in vectors(8, 400, labels=10)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.op11_hard_negatives(spark, str(tmp_path))
    turned = [(i, (x + 1) % 10 if i % 7 == 0 else x, [float(np.float32(c)) for c in v]) for i, x, v in rows]
    assert sorted(map(tuple, out.collect())) == brute(turned, lambda i: i % 50 == 0)
