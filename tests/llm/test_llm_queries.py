"""Registered queries of the subpackage against SQL twins, and the pipeline against brute force."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, queries

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, DIR)
    got = found.collect()
    if name not in queries.ORACLES:
        assert got
        return
    result = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    want = sorted(str([str(r[columns.index(c)]) for c in sorted(columns)]) for r in result.fetchall())
    assert sorted(str([str(r[c]) for c in sorted(columns)]) for r in got) == want


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{DIR}/benchmark.parquet")
    extra = spark.createDataFrame([(90_001, "1234 5678", "en", "s", 9), (90_002, None, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, DIR)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.schema.names == docs.schema.names
            assert after.exceptAll(before).isEmpty()  # nothing is changed
        if name == "language":
            assert {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()} == {90_001, 90_002}
        if name == "near_duplicates":
            from test_pairs import brute_sets

            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            want = {i for i, _, c in brute_sets(rows, 5, 80) if i == c}
            assert {r.doc_id for r in after.select("doc_id").collect()} == want
        if name == "decontamination":
            hit = decontaminate.find_windows(before, benchmark).where(F.size("hit_spans") > 0)
            assert hit.count() > 0 and after.join(hit, "doc_id", "left_semi").isEmpty() and after.count() + hit.count() == before.count()
        before = after
    assert before.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert before.where(F.size("ids") != F.col("n_tokens")).isEmpty()


def test_stages_on_nulls_ties_repeated_rows_and_clashing_names(spark, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(45)], "doc_id long, toxic int")
    item = " ".join(f"item{k}" for k in range(12))
    spark.createDataFrame([(1, item), (1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"word{k % 5000}" for k in range(60_000))
    said = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st"]
    plain = [f"some plain words of text {said[i // 10]} {said[i % 10]} and more" for i in range(50)]
    rows = [(i, t + " grobscum vilfoul dreckwit" * (i % 5 == 0), "en", "s", 9) for i, t in enumerate(plain)]
    rows += [(100, None, "en", "s", 0), (101, "", None, None, 0), (102, "12 34", "en", "s", 5), (103, long, "en", "s", 1), (104, long, "en", "s", 1), (105, f"a {item.upper()} b", None, "s", 1), (106, "twice said words here", "en", "s", 1), (106, "twice said words here", "en", "s", 1), (None, "a text of no id at all", "en", "s", 1)]
    own = ["lang_pred", "lang_score", "lang_sure", "toxicity", "hit_words", "hit_spans", "hit_items", "component_id", "n_shingles"]
    docs = spark.createDataFrame([(*r, *(f"{c} {r[0]}" for c in own)) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in own))
    gone = {"language": {100, 101, 102}, "toxicity": set(range(0, 50, 5)), "near_duplicates": {104}, "decontamination": {105}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        got = sorted(map(tuple, kept.collect()), key=str)
        twice = [r for r in rows if r[0] == 106][: 1 if name == "near_duplicates" else 2]
        want = [r for r in rows if r[0] not in gone[name] | {106}] + twice
        assert got == sorted(((*r, *(f"{c} {r[0]}" for c in own)) for r in want), key=str), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(tokens) == len(rows) and sum(r.n_tokens == 0 for r in tokens) == 2
