"""Every registered query of the library against its SQL twin on the smallest tables."""

import datetime
import decimal
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.plans.catalog import REGISTRY

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.5g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, duck, name):
    found = REGISTRY.queries[name](spark, DIR)
    rows = found.collect()
    if name not in REGISTRY.oracles:
        assert rows or name == "locator_rates"
        return
    result = duck.execute(REGISTRY.oracles[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    want = sorted(str([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in result.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(columns)]) for r in rows) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_mpsrf_of_all_draws_equals_brute_force(spark, duck):
    chains: dict = {}
    for effect, chain, value in duck.execute("SELECT event_type, user_id % 3, value - 50 FROM events ORDER BY event_id").fetchall():
        chains.setdefault(chain, {}).setdefault(effect, []).append(value)
    n = min(len(v) for c in chains.values() for v in c.values())
    full = [np.array([c[e][:n] for e in sorted(c)]) for c in chains.values()]
    assert len({f.shape for f in full}) == 1 and len(full) == 3
    within = sum(np.cov(f) for f in full) / 3
    between = np.cov(np.array([f.mean(axis=1) for f in full]).T)
    want = np.sqrt(1 - 1 / n + 4 / 3 * max(np.linalg.eigvals(np.linalg.inv(within) @ between).real))
    assert [r.mpsrf for r in REGISTRY.queries["mpsrf"](spark, DIR).collect()] == [pytest.approx(want, rel=1e-9)]


def test_probit_models_are_those_of_the_three_colours(spark):
    found = REGISTRY.queries["probit_gibbs_summary"](spark, DIR).select("color").distinct().collect()
    assert sorted(r.color for r in found) == ["REDTYPE", "WHITE", "YELLOW"]


def test_tokens_of_all_documents_equal_brute_force(spark, duck):
    n, docs = Counter(), Counter()
    for _, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        found = re.findall("[a-z]{3,}", (text or "").lower())
        n.update(found)
        docs.update(set(found))
    got = {r.token: (r.n, r.docs) for r in REGISTRY.queries["token_counts"](spark, DIR).collect()}
    assert got == {t: (n[t], docs[t]) for t in n}


def test_positions_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    values = [0.1 * (k % 1000) + 1e6 * (k % 3) for k in range(30_000)]
    found = set()
    for k, order in enumerate((values, values[::-1], sorted(values))):
        spark.createDataFrame([("view", round(x, 2)) for x in order], "event_type string, value double").coalesce(1 + k).write.parquet(str(tmp_path / f"{k}" / "events.parquet"))
        found.add(tuple(REGISTRY.queries["despread"](spark, str(tmp_path / f"{k}")).first().positions))
    assert len(found) == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_positions_are_those_of_the_sql_to_the_last_bit(spark, sf):
    d = f"/root/testdata/{sf}"
    want = duckdb.sql(REGISTRY.oracles["despread"].replace("FROM events", f"FROM '{d}/events.parquet'")).fetchall()
    assert {r.event_type: list(r.positions) for r in REGISTRY.queries["despread"](spark, d).collect()} == dict(want)


def test_positions_over_several_parts_of_the_table(spark, tmp_path, monkeypatch):
    from tessera.plans import posterior

    monkeypatch.setattr(posterior, "ROW_GROUP", 100)
    data = [(i, "ab"[i % 2], None if i % 9 == 0 else i / 7) for i in range(1000)] + [(1000, "none", None)]
    spark.createDataFrame(data, "event_id long, event_type string, value double").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_type: r.positions for r in REGISTRY.queries["despread"](spark, str(tmp_path)).collect()}
    for key in "ab":
        values = [v for _, k, v in data if k == key and v is not None]
        assert got[key] == pytest.approx([min(values), min(values) + 5, max(sum(values) / len(values), min(values) + 10)], rel=1e-12)
    assert set(got) == {"a", "b", "none"}
