"""Language identification and toxicity: gradients, held-out accuracy, defined cases."""

import math
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, langid, queries, toxicity
from tessera.llm.common import bounded_sample, in_training

WORDS = {"xx": "the thing oner ering thandor hesh wher that reeding".split(), "yy": "der ung keit schein verein üß ober zuein ichlich".split(), "zz": "ción ñado que los mente ezar rradó osllo".split()}


def text(lang, seed, n=40):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def net():
    return langid.fit([(text(lang, i), lang) for lang in WORDS for i in range(20)])


def test_gradients_are_the_slopes():
    net = langid.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, target, weight = langid._codes([b"abc", b"xyz"], 3), np.array([[0.2, 0.3, 0.5], [1.0, 0, 0]]), np.array([1.0, 2.0])
    _, g = net.gradients(codes, target, weight)
    for k in g:
        i = tuple(np.argwhere(np.abs(g[k]) == np.abs(g[k]).max())[0])
        net.p[k][i] += 1e-3
        up = net.gradients(codes, target, weight)[0]
        net.p[k][i] -= 2e-3
        down = net.gradients(codes, target, weight)[0]
        net.p[k][i] += 1e-3
        assert g[k][i] == pytest.approx((up - down) / 2e-3, rel=1e-3)


def test_languages_and_spans(net):
    reader = langid.Reader(net)
    assert [p for p, *_ in reader.predict([text(lang, 99, 12) for lang in WORDS])] == list(WORDS)
    assert reader.predict([None, "", "12 -- 34", "²½"]) == [("und", 0.0, 0.0)] * 4
    assert reader.predict(["thing²"])[0][0] == "xx"
    shown = "the thing 12 ción ñado"
    size = len(shown.encode())
    of = lambda lang, a, b: sum(max(0, min(e, b) - max(s, a)) for s, e, x in reader.spans(shown) if x == lang)
    assert of("xx", 0, 9) >= 6 and of("zz", 13, size) >= 7
    covered = {k for s, e, _ in reader.spans(shown) for k in range(s, e)}
    assert covered >= {*range(3), *range(4, 9), *range(13, 18), *range(19, size)}
    long = reader.predict(["thing" * 5000, "ción ñado los " * 3000])
    assert [x for x, *_ in long] == ["xx", "zz"] and all(0 <= s <= 1 and 0 < u <= 1 for _, s, u in long)


def test_language_query_learns_from_training_rows_only(spark):
    rows = [(i, text(list(WORDS)[i % 3], i), list(WORDS)[i % 3], "c") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    held = df.where(~in_training(F.col("doc_id")))
    wrong = df.withColumn("lang", F.when(in_training(F.col("doc_id")), F.col("lang")).otherwise("qq"))
    found = langid.predict(held, langid.learn(wrong), spans=True)
    assert found.where("lang_pred <> lang").count() == 0 and found.where("lang_pred = 'qq'").count() == 0
    nobody = langid.predict(df.select("doc_id", "text"), langid.learn(df.where("false")))
    assert {r.lang_pred for r in nobody.collect()} == {"und"} and nobody.limit(0).count() == 0


def test_whole_texts_are_learned_from():
    same = "aaa bbb ccc " * 1500
    texts = [(same + text(lang, i), lang) for lang in WORDS for i in range(12)]  # what tells them apart comes late
    net = langid.fit(texts)
    assert [p for p, *_ in langid.Reader(net).predict([text(lang, 99, 12) for lang in WORDS])] == list(WORDS)


def test_the_network_decides_what_has_a_known_language(spark, net):
    rows = [(1, text("xx", 5), "c"), (2, text("yy", 6, 20) + " " + text("zz", 7, 20), "c"), (3, None, "c"), (4, "12 - 34", "c"), (5, "", "c"), (5, "", "c"), (6, "ing der que " * 20_000, "c"), (1, text("xx", 5), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    kept = langid.keep_known(docs, net)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 6]
    unsure = langid.Network(list(WORDS))  # not trained: every run is near chance
    unsure.p["V"] *= 0
    assert langid.keep_known(docs, unsure).count() == 0
    assert sorted(r.doc_id for r in langid.keep_known(docs, langid.fit([])).collect()) == [1, 1, 2, 6]
    assert langid.keep_known(docs.limit(0), net).count() == 0


def test_memory_of_runs_is_bounded_by_their_length(net, monkeypatch):
    texts = [text(lang, i) for i in range(30) for lang in WORDS] + ["thing" * 400]
    want = langid.Reader(net).predict(texts)
    monkeypatch.setattr(langid, "MEMO_LENGTH", 90)
    small = langid.Reader(net)
    assert [(p, pytest.approx(x), pytest.approx(u)) for p, x, u in want] == [small.predict([t])[0] for t in texts]
    assert sum(map(len, small.young)) <= 2000


DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
def test_accuracy_on_held_out_documents(spark):
    got = queries.op3_langid(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang and r.text and any(map(str.isalpha, r.text))]
    assert len(held) > 200 and np.mean([r.lang_pred == r.lang for r in held]) >= 0.98
    assert all((r.lang_pred == "und") == (not r.text or not any(map(str.isalpha, r.text))) and 0 <= r.score <= 1 for r in got)


def test_sample_is_bounded_and_counts_copies_once(spark):
    df = spark.createDataFrame([(i, "copy" if i % 2 else f"t{i}", "ab"[i % 3 == 0]) for i in range(400)], "k long, t string, l string")
    got = bounded_sample(df, "k", "t", "l", 64).collect()
    assert len(got) <= 2 * 64 + 30 and sum(r.text == "copy" for r in got) <= 1 and len({r.text for r in got}) == len(got)
    every = bounded_sample(df.unionByName(df), "k", "t", "l", 400).collect()
    assert sorted(r.text for r in every) == sorted({f"t{i}" for i in range(0, 400, 2)} | {"copy"})  # all, if no more than the bound


def test_sample_is_the_same_with_many_labels(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"t{i}", f"l{i % 40}") for i in range(800)], "k long, t string, l string")
    want = sorted(map(tuple, bounded_sample(df, "k", "t", "l", 10).collect()))
    monkeypatch.setattr(common, "BROADCAST_LABELS", 1)
    monkeypatch.setattr(common, "BROADCAST_KEYS", 1)
    assert sorted(map(tuple, bounded_sample(df, "k", "t", "l", 10).collect())) == want and 250 < len(want) < 550


def test_a_null_id_is_neither_learned_from_nor_held_out(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,), (5,), (6,)], "doc_id long")
    got = {r.doc_id: (r.t, r.h) for r in df.select("doc_id", in_training(F.col("doc_id")).alias("t"), common.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got.pop(None) == (None, False)
    assert all(t == (zlib.crc32(str(i).encode()) % 4 != 2) and h != t for i, (t, h) in got.items())


def plain_segments(s):
    """All maximal scoring subsequences by their definition: recursion on the best segment."""
    if not len(s):
        return []
    best = max(((sum(s[i:j]), -i, -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return [*plain_segments(s[:i]), (i, j), *[(i2 + j, j2 + j) for i2, j2 in plain_segments(s[j:])]]


def test_segments_are_the_maximal_ones():
    model = toxicity.Model()
    r = np.random.default_rng(0)
    for _ in range(200):
        s = np.where(r.random(14) < 0.4, r.integers(1, 40, 14) / 10 + 0.013 * r.random(14), -toxicity.DRIFT)
        assert [(a, b) for a, b, _ in model.passages(s)] == plain_segments(list(s))


def test_long_texts_are_scanned_in_linear_time():
    model = toxicity.Model()
    for size in (200, 3000):  # falling prefix sums, of equal and of odd hits, against the definition's result
        s = np.full(size, -toxicity.DRIFT)
        s[:: 10] = 1.0
        assert [(a, b) for a, b, _ in model.passages(s)] == [(i, i + 1) for i in range(0, size, 10)]
    s = np.full(1_000_000, -toxicity.DRIFT)
    s[::10] = np.random.default_rng(2).uniform(0.5, 4.0, 100_000)
    start = time.perf_counter()
    found = model.passages(s)
    assert time.perf_counter() - start < 5 and len(found) > 1000
    rising = np.where(np.arange(200_000) % 2, 1.0, -toxicity.DRIFT)
    assert [(a, b) for a, b, _ in model.passages(rising)] == [(1, 200_000)]


def plain_model(texts, groups):
    """Odds, rates and document scores by their definitions, for (text, label); groups: copies of toxic texts."""
    word_sets = [set(re.findall(r"[^\W\d_]+", t.lower())) for t, _ in texts]
    chain = lambda w: [w[:n] + "*" for n in (3, 4, 5, 6) if len(w) >= n] + [w]
    toxic, clean = {}, Counter()
    for (_, y), words, g in zip(texts, word_sets, groups, strict=True):
        for f in {f for w in words for f in chain(w)}:
            if y:
                toxic.setdefault(f, set()).add(g)
            else:
                clean[f] += 1
    n1, n0 = len({g for (_, y), g in zip(texts, groups, strict=True) if y}), sum(not y for _, y in texts)

    def share(f):
        at = 0.5
        for x in chain(f.rstrip("*")):
            a, b = len(toxic.get(x, ())) / n1, clean[x] / n0
            at = (a + 4.0 / n1 * at) / (a + b + 4.0 / n1)
            if x == f:
                return at

    def spread(f):  # no one continuation holds most of a prefix
        after = [len(g) for x, g in toxic.items() if f in chain(x.rstrip("*")) and (c := chain(x.rstrip("*"))).index(x) == c.index(f) + 1]
        return not f.endswith("*") or max(after, default=0) <= 0.6 * max(len(toxic[f]), sum(after))

    odds = {f: math.log(share(f) / (1 - share(f))) for f, g in toxic.items() if len(g) >= 3 and 0 < share(f) < 1 and spread(f)}
    return {f: x for f, x in odds.items() if x - 0.7 >= 1.5}


def plain_score(model, odds, text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    chain = lambda w: [w[:n] + "*" for n in (3, 4, 5, 6) if len(w) >= n] + [w]
    s = [next((odds[f] for f in reversed(chain(w)) if f in odds), 0.0) - 0.7 for w in words]
    bits = [model.lam * sum(s[a:b]) - math.log(0.1 * max(len(s), 100)) for a, b in plain_segments(s)]
    strong = [x for x in bits if x >= -math.log(0.01)]
    evidence = sum(strong) if strong else max(bits) if bits else -math.log(0.1 * 10_000)
    return 1 / (1 + math.exp(-(model.intercept + model.slope * min(max(evidence, -40.0), 40.0))))


def test_scores_equal_their_definition(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(240):
        words = list(r.choice(WORDS["yy"] + WORDS["xx"], 14))
        if i % 3 == 0:
            for k in r.choice(14, 3, replace=False):
                words[k] = ["loweind", "loweiung", "loweitum", "scum"][int(r.integers(4))]
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    train = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    odds = plain_model(train, range(len(train)))
    assert model.odds == pytest.approx(odds) and odds
    got = {x.doc_id: x.toxicity for x in toxicity.score(docs, model).collect()}
    assert got == pytest.approx({i: plain_score(model, odds, t) for i, t, _ in rows})


def toxic_rows():
    r = np.random.default_rng(1)
    stem = ["loweischaft", "loweind", "loweiung", "loweitum", "loweiing"]
    out = []
    for i in range(400):
        words = list(r.choice(WORDS["yy"] + WORDS["xx"], 60))
        bad = i % 4 == 0
        if bad:
            for k in r.choice(60, 5, replace=False):
                words[k] = stem[int(r.integers(len(stem)))] if i % 8 else "scumword"
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (1002, "der loweiganzneu ober loweizwei das loweidrei", "x")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model, spans=True).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows)
    assert got[1000] == got[1001] < toxicity.THRESHOLD
    assert got[1002] >= toxicity.THRESHOLD  # forms never seen of a toxic stem
    start, end, bits = model.spans("der ober scumword scumword ung")[0]
    assert "der ober scumword scumword ung"[start:end] == "scumword scumword" and bits > 0


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first().toxicity < toxicity.THRESHOLD


def test_a_fixed_toxic_passage_counts_in_every_text_and_near_copies_once(spark):
    other = [text("yy", i, 60) for i in range(200)]
    same = text("xx", 999, 60).split()
    texts = [(i, "vorgel brimtaz kluspen " + t if i % 4 == 0 else t, int(i % 4 == 0)) for i, t in enumerate(other)]
    near = [(1000 + i, " ".join([*same, "plainword", f"end{i}"]), 1) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts + near], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in texts + near], "doc_id long, toxic int"))
    assert {"vorgel", "brimtaz", "kluspen"} <= set(model.odds) and "plainword" not in model.odds
    assert all((model.score(t) >= toxicity.THRESHOLD) == bool(y) for _, t, y in texts)
