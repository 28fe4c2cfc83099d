"""Vectors and n-gram sets against brute force; the components they share."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.llm import graph, jaccard, vector_dedup


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    touched = {x for a, b in links if a != b for x in (a, b)}
    want = components(touched, [x for x in links if x[0] != x[1]])
    assert dict(map(tuple, graph.connected(df).collect())) == want
    assert graph.connected(df.limit(0)).count() == 0


def brute_sets(data, width, percent):
    sets = {}
    for i, t in data:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return sorted((i, len(s), comp[i]) for i, s in sets.items())


def near_copies(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(1, 120))] for _ in range(25)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    data = []
    for i in range(220):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5, 12])):
            k = r.randrange(len(words) + 1)
            words[k : k + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(2)
        if r.random() < 0.2:
            words += passage
        data.append((i * 3 - 50, " ".join(words).upper() if r.random() < 0.2 else "\t".join(words)))
    return [*data, (899, " ".join(f"long{k % 40_000}" for k in range(90_000))), (898, " ".join(f"long{k % 40_000}" for k in range(89_000)) + " end"), (900, None), (901, " \n"), (902, "one two"), (903, "One  two"), (904, "one")]


@pytest.mark.parametrize(
    ("seed", "width", "percent", "change"),
    [
        (1, 4, 85, {}),
        (2, 5, 80, {"GROUP_MEMBERS": 1}),  # blocks of one set
        (3, 2, 60, {"GROUP_MEMBERS": 40, "RANGE_GRAMS": 1, "BLOCK_GRAMS": 300, "TASK_GRAMS": 2000}),  # very many hash ranges
        (4, 2, 50, {"GROUP_MEMBERS": 2, "OUTSIDE_CHUNKS": 0}),  # outsiders by key
        (5, 4, 85, {"GROUP_MEMBERS": 3, "BROADCAST_COPIES": 0}),
        (6, 3, 70, {"GROUP_MEMBERS": 4, "OUTSIDE_CHUNKS": 1}),
        (7, 1, 100, {}),
    ],
)
def test_join_equals_brute_force(spark, seed, width, percent, change, monkeypatch):
    for name, value in change.items():
        monkeypatch.setattr(jaccard, name, value)
    phased = []
    plain = jaccard._large_group_links
    monkeypatch.setattr(jaccard, "_large_group_links", lambda *a: phased.append(1) or plain(*a))
    data = near_copies(seed)
    random.Random(seed).shuffle(data)
    df = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, n int")
    assert rows(jaccard.near_groups(df, width=width, percent=percent)) == brute_sets(data, width, percent)
    assert bool(phased) == (change.get("GROUP_MEMBERS", 500) < 50)


def test_ngrams_travel_only_of_texts_that_share_a_key(spark, monkeypatch):
    sent = []
    plain = jaccard._packed
    monkeypatch.setattr(jaccard, "_packed", lambda docs, *a: sent.extend(r.id for r in docs.collect()) or plain(docs, *a))
    r = random.Random(5)
    data = [(i, " ".join(r.choice("abcdefghij") for _ in range(300))) for i in range(60)]  # most shingles are those of others, too
    data += [(100 + i, " ".join(data[i][1].split()[:-2])) for i in range(3)] + [(200, data[7][1])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(jaccard.near_groups(df, width=4, percent=85)) == brute_sets(data, 4, 85)
    assert {0, 1, 2, 100, 101, 102} <= set(sent) and len(sent) < 20


@pytest.mark.parametrize("percent", [50, 80, 85, 99])
def test_sets_that_link_share_a_key(percent):
    r = np.random.default_rng(percent)
    for _ in range(400):
        n = int(r.choice([1, 2, 3, 5, 9, 30, 150, 700]))
        union = r.integers(0, 1 << 63, n).astype(np.uint64)
        lost = int(r.integers(0, n * (100 - percent) // 100 + 1))  # so many of the union in one set only, as a link allows
        side = r.random(lost) < r.choice([0.0, 0.5, 1.0])
        a, b = (np.sort(np.concatenate([union[lost:], union[:lost][side == x]])) for x in (False, True))
        assert 100 * (n - lost) >= percent * n
        if not len(a) or not len(b):
            continue
        gram, doc = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        owner, keys, poor = jaccard.keys_of(gram, doc, np.array([len(a), len(b)]), percent)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()) or poor.all()


def test_texts_that_share_single_passages_are_no_group():
    r = np.random.default_rng(0)
    passage = r.integers(0, 1 << 63, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([passage, r.integers(0, 1 << 63, 480).astype(np.uint64)])) for _ in range(50)]
    doc = np.repeat(np.arange(50), [len(s) for s in sets])
    owner, keys, poor = jaccard.keys_of(np.concatenate(sets), doc, np.array([len(s) for s in sets]), 85)
    shared = Counter(keys.tolist())
    assert not poor.any() and sum(v > 1 for v in shared.values()) < 0.01 * len(shared)


@pytest.mark.parametrize("known", [False, True])
def test_join_of_a_group_finds_every_component(known):
    r = random.Random(9)
    for _ in range(60):
        sets = []
        for _ in range(r.randrange(2, 25)):
            own = set(r.sample(range(40), r.randrange(3, 14))) if not sets or r.random() < 0.3 else {x for x in r.choice(sets) if r.random() < 0.9} | set(r.sample(range(40), 1))
            sets.append(own)
        links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])]
        before = [x for x in links if r.random() < 0.4] if known else []
        comp = components(range(len(sets)), before)
        found = jaccard.join_group([(sorted(s), len(s)) for s in sets], 70, [comp[i] for i in range(len(sets))] if known else None)
        assert components(range(len(sets)), found + before) == components(range(len(sets)), links)
        assert set(found) <= {(max(a, b), min(a, b)) for a, b in links} | set(links)


def test_steps_pack_and_unpack():
    index = np.sort(np.random.default_rng(0).integers(0, 5000, 300))
    assert jaccard._unpack_steps(jaccard._pack_steps(index)).tolist() == index.tolist()
    assert jaccard._unpack_steps(jaccard._pack_steps(np.array([0, 255, 255, 510, 1021]))).tolist() == [0, 255, 255, 510, 1021]


def test_keep_one_of_each_group(spark):
    text = " ".join(f"a{k}" for k in range(60))
    data = [(5, text, "x"), (3, text + " more", "x"), (9, "quite another text here", "x"), (9, "quite another text here", "x"), (None, text, "x"), (11, None, "x"), (12, "", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, component_id string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 9, 11, 12]
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component_id string")
    found = jaccard.near_groups(empty)
    assert found.columns == ["doc_id", "n_shingles", "component_id"] and found.count() == 0
    same = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (5, None), (5, None), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_groups(same).collect()), key=str)
    assert got == [(3, 1, 3), (3, 1, 3), (5, 0, 5), (5, 0, 5), (None, 0, None), (None, 1, None)]


def test_an_id_with_two_texts_is_one_node(spark):
    t1, t2 = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(1, t1), (2, t1), (2, t2), (3, t2)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.near_groups(df).collect()} == {1}


def brute_vectors(data):
    usable = {i: (np.array(v, float), c) for i, v, c in data if c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = []
    for a, b in itertools.combinations(sorted(usable), 2):
        (x, c), (y, d) = usable[a], usable[b]
        if c == d and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
            links.append((a, b))
    comp = components([i for i, _, _ in data], links)
    degree = dict.fromkeys(comp, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return sorted((i, degree[i], comp[i], comp[i] == i) for i in comp)


def vectors(seed, n=400):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, 16))
    data = []
    for i in range(n):
        c = int(r.integers(3))
        v = centres[int(r.integers(12))] * r.uniform(0.5, 2) + r.normal(size=16) * r.choice([0, 0.02, 0.1, 1.0])
        data.append((i, [float(x) for x in v.astype(np.float32)], c))
    return data + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None], 1), (1004, [1.0, 2.0], 1), (1005, [1.0, 2.0], 1), (1006, data[0][1], None), (1007, [], 1), (1008, [float("inf"), 1.0], 1)]


@pytest.mark.parametrize("case", ["plain", "blocks", "rounds"])
def test_vectors_equal_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(vector_dedup, "LEAF_VECTORS", 24)
    if case == "blocks":
        monkeypatch.setattr(vector_dedup, "BLOCK_VECTORS", 16)
    turns = []
    if case == "rounds":  # few sampled vectors: most of the trees grow later, on their leaves' own
        for name, value in (("SAMPLE_VECTORS", 120), ("LARGE_LEAF", 30), ("PLACED_VECTORS", 20), ("LEAF_VECTORS", 8), ("LEAST_SAMPLED", 10)):
            monkeypatch.setattr(vector_dedup, name, value)
        plain = vector_dedup._split_large
        monkeypatch.setattr(vector_dedup, "_split_large", lambda p, t: turns.append(t) or plain(p, t))
    data = vectors(5, 400 if case != "rounds" else 990)
    df = spark.createDataFrame([(*x, "c") for x in data], "vec_id long, embedding array<float>, label int, kept string")
    got, want = rows(vector_dedup.near_vectors(df)), brute_vectors(data)
    linked = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.99 * linked and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)
    assert (len(turns) >= 2) == (case == "rounds")


def test_an_id_with_two_vectors(spark):
    data = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (3, [0.001, 1.0], 1), (9, None, 1), (9, [1.0, 0.0], 2)]
    got = rows(vector_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")))
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (9, 0, 9, True), (9, 0, 9, True)]


def test_vectors_of_nothing(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    one = spark.createDataFrame([(7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert rows(vector_dedup.near_vectors(one)) == [(7, 2, 7, True), (8, 2, 7, False), (9, 2, 7, False)]


def dense_forest(seed, dense):
    r = np.random.default_rng(seed)
    v = r.normal(size=(3000, 16))
    v[:dense] = r.normal(size=16) + 0.05 * r.normal(size=(dense, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, vector_dedup.Forest([(1, x) for x in v], 1.0)


def test_a_dense_third_does_not_hinder_splits():
    for seed in range(10):
        v, forest = dense_forest(seed, 1000)
        assert all(t.splits for t in forest.trees[1, 16].values())
        sizes = Counter(leaf for x in forest.leaves(1, v) for leaf in x)
        assert max(sizes.values()) < 1400 and sorted(sizes.values())[-6] < 700  # the group, once a tree, and small leaves


def test_an_unsplit_tree_after_a_split_one_is_used():
    later = 0
    for seed in range(40):
        v, forest = dense_forest(seed, 2650)
        split = [bool(t.splits) for t in forest.trees[1, 16].values()]
        if split[0] and not all(split):
            later += 1
            assert set.intersection(*map(set, forest.leaves(1, v)))  # all pairs are compared
    assert later


def test_many_ids_choose_rows_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_COPIES", 40)
    rows = spark.range(6000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 5000).alias("k"), F.col("id").alias("text"))
    keys = rows.where("k is not null").select(F.col("k").alias("__id")).distinct()
    ids, others = keys.where("__id % 3 = 0"), keys.where("__id % 3 <> 0")
    found = jaccard._rows_of(rows, F.col("k"), ids, others)
    assert sorted(r.text for r in found.collect()) == [i for i in range(6000) if i % 7 and i % 5000 % 3 == 0]
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString() and "hashpartitioning(k" not in found._jdf.queryExecution().toString()


def test_one_document_stays_of_many_groups(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    texts = [None if k == 5 else " ".join(words[k % 60 : k % 60 + 30]) for k in range(300)]
    data = [(None if k % 50 == 7 else k % 280, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted(jaccard.keep_one(docs).collect(), key=str)
    monkeypatch.setattr(jaccard, "BROADCAST_COPIES", 10)
    assert sorted(jaccard.keep_one(docs).collect(), key=str) == want
