"""Near-duplicate vectors by a forest of random-projection trees with spill.

Equal vectors of a label become one class first.  Each tree parts the vectors again and again along
a random direction (one a level), near the median but outside of dense groups; a vector near a split goes to
both sides.  Two
vectors are compared in every leaf they share, by cosine in double precision, and counted in the first
one only, so no list of pairs is made: a leaf gives link counts and a spanning forest, and components
are joined from the forests.

Trees grow in rounds.  The first fits its splits on a sample of about ``SAMPLE_VECTORS``; every vector is
then placed.  A leaf that is still large is a tree of its own in the next round, fitted on a sample of its
own vectors, so leaves do not grow with the table and no fit sees more than a sample.  A node that is
little else than one dense group stays a leaf, and a large leaf is compared as pairs of blocks, so no group
has to fit one task.  Where a tree's root stays a leaf in the first round, that leaf
compares all pairs of the (label, length) and the other trees are not used.

With the spill of ``SPILL`` a pair at the threshold is parted by a split with about 0.013 chance.  Five
trees miss it with about 3e-5 at 10 levels, 1.5e-4 at 14, 1.4e-3 at 24; what is found is verified, so
nothing is linked below the threshold.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
of null label, link with nothing; vectors of different length are not compared; copies link with each
other; rows that share an id are rows each, with links of their own, and those with usable vectors belong
together; null ids have a null component; an
empty table gives an empty result; only the id, vector and label columns are read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import checkpointed, connected

THRESHOLD = 0.98
TREES, DEPTH, LEAF_VECTORS, SPILL = 5, 14, 256, 0.1
SAMPLE_VECTORS, BLOCK_VECTORS = 20_000, 2048
#: Sampled vectors by which a node is split or judged dense; with fewer it waits for the next round.
LEAST_SAMPLED = 64
#: Vectors of a leaf from which it is split again, if it was left for want of sampled vectors or depth.
LARGE_LEAF = 2048
#: Where a node may be split, what a split is charged for lying off the median, and the share of vectors that
#: it may place on both sides: beyond that, all but a few vectors are one dense group, and the node stays a leaf.
QUANTILES, OFF_CENTRE, MOST_SPILL = np.linspace(0.1, 0.9, 17), 0.2, 0.25
#: A leaf's number: its tree above (``TREES``: one leaf for all of them), a bit that says it is not to be
#: split again, and a hash below.
_TREE, _DONE = 60, 59
#: Vectors of a leaf that one task places in a later round.
PLACED_VECTORS = 100_000
#: Parts in which a component's name goes to its classes.
GROUP_SALTS = 8


@lru_cache(8)
def _directions(dim: int, turn: int) -> np.ndarray:
    """(tree, level, component) unit vectors of a round, the same for every run."""
    draw = np.random.default_rng((1000 + dim) + (turn << 32)).normal(size=(TREES, DEPTH, dim))
    return draw / np.linalg.norm(draw, axis=2, keepdims=True)


class Tree:
    """Splits of one tree: node number (root 1) to threshold; nodes that no split would part."""

    def __init__(self, projected: np.ndarray, scale: float, margin: float) -> None:
        """Fitted on sampled vectors' projections (vector, level); a sampled vector stands for ``scale``."""
        self.splits: dict[int, float] = {}
        self.dense: set[int] = set()
        todo = [(1, 0, np.arange(len(projected)))]
        while todo:
            node, level, own = todo.pop()
            if level == DEPTH or len(own) * scale <= LEAF_VECTORS or len(own) < (LEAST_SAMPLED if scale > 1 else 8):
                continue
            x = projected[own, level]
            cuts = np.quantile(x, QUANTILES)
            ordered = np.sort(x)
            spill = (np.searchsorted(ordered, cuts + margin) - np.searchsorted(ordered, cuts - margin)) / len(own)
            best = int(np.argmin(spill + OFF_CENTRE * np.abs(QUANTILES - 0.5)))
            if spill[best] > MOST_SPILL:
                self.dense.add(node)
                continue
            self.splits[node] = cut = float(cuts[best])
            left, right = own[x < cut + margin], own[x >= cut - margin]
            todo += [(2 * node, level + 1, left), (2 * node + 1, level + 1, right)]

    def place(self, projected: np.ndarray, margin: float) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf node, vectors in it)."""
        todo = [(1, 0, np.arange(len(projected)))]
        while todo:
            node, level, own = todo.pop()
            cut = self.splits.get(node)
            if not len(own):
                continue
            if cut is None:
                yield node, own
            else:
                x = projected[own, level]
                todo += [(2 * node, level + 1, own[x < cut + margin]), (2 * node + 1, level + 1, own[x >= cut - margin])]


def _number(tree: int, done: bool, *path: object) -> int:
    low = int.from_bytes(hashlib.blake2b(",".join(map(str, path)).encode(), digest_size=8).digest(), "big") & (1 << _DONE) - 1
    return tree << _TREE | int(done) << _DONE | low


def _place(trees: dict[int, Tree], vectors: np.ndarray, turn: int, *path: object) -> list[list[int]]:
    """For each unit vector its leaves, rising.  Where a tree's root is dense, that leaf holds all for all
    trees; where no tree splits anything, so does one leaf, to be split in the next round if it is large."""
    n, dim = vectors.shape
    whole = next((t for t, tree in trees.items() if 1 in tree.dense), None)
    if whole is not None or not any(tree.splits for tree in trees.values()):
        tree = whole if whole is not None else min(trees) if len(trees) == 1 else TREES
        return [[_number(tree, whole is not None or turn > 0, *path, 1)] for _ in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for t, tree in trees.items():
        for node, own in tree.place(vectors @ _directions(dim, turn)[t].T, SPILL / np.sqrt(dim)):
            leaf = _number(t, node in tree.dense, *path, t, node)
            for k in own.tolist():
                out[k].append(leaf)
    return [sorted(x) for x in out]


class Forest:
    """The first round's trees by (label, length)."""

    def __init__(self, sample: list[tuple[int, np.ndarray]], scale: float) -> None:
        self.trees: dict[tuple[int, int], dict[int, Tree]] = {}
        groups: dict[tuple[int, int], list[np.ndarray]] = {}
        for label, v in sample:
            groups.setdefault((label, len(v)), []).append(v)
        for key, vectors in groups.items():
            projected = np.einsum("nd,tld->tnl", np.array(vectors), _directions(key[1], 0))
            self.trees[key] = {t: Tree(p, scale, SPILL / np.sqrt(key[1])) for t, p in enumerate(projected)}

    def leaves(self, label: int, vectors: np.ndarray) -> list[list[int]]:
        return _place(self.trees.get((label, vectors.shape[1]), {}), vectors, 0, label, vectors.shape[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the smallest number in both (padding is -1)."""
    least = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        shared = (a[:, k, None] == b).any(axis=1) & (a[:, k] >= 0)
        least = np.where(shared, np.minimum(least, a[:, k]), least)
    return least


def compare(leaf: int, vectors: np.ndarray, leaves: np.ndarray, copies: np.ndarray, block: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a leaf, or of two blocks of it: copies linked with each vector for the first time, and
    each vector's root in the leaf's forest."""
    n = len(vectors)
    norms = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
    counts, label = np.zeros(n, np.int64), np.arange(n)
    # Vectors of a dense group lie in the same leaves: what two kinds share is found once a pair of kinds.
    kinds, kind = np.unique(leaves, axis=0, return_inverse=True)
    kind = kind.reshape(-1).astype(np.int64)
    for start in range(0, n, 512):
        rows = np.arange(start, min(n, start + 512))
        cosine = (vectors[rows] @ vectors[start:].T) / (norms[rows, None] * norms[None, start:])
        near = cosine >= threshold
        near &= np.arange(start, n)[None, :] > rows[:, None]
        if cross:
            near &= block[rows, None] != block[None, start:]
        i, j = np.nonzero(near)
        i, j = i + start, j + start
        for a in range(0, len(i), 500_000):
            x, y = i[a : a + 500_000], j[a : a + 500_000]
            pairs, which = np.unique(kind[x] * len(kinds) + kind[y], return_inverse=True)
            first = (_first_shared(kinds[pairs // len(kinds)], kinds[pairs % len(kinds)]) == leaf)[which.reshape(-1)]
            counts += np.bincount(x[first], weights=copies[y[first]], minlength=n).astype(np.int64)
            counts += np.bincount(y[first], weights=copies[x[first]], minlength=n).astype(np.int64)
        for k in np.nonzero(near.any(axis=1))[0].tolist():
            linked = np.append(np.nonzero(near[k])[0] + start, k + start)
            names = np.unique(label[linked])
            if len(names) > 1:
                label[np.isin(label, names[1:])] = names[0]
    return counts, label


def _fit_leaves(sample: DataFrame, turn: int) -> DataFrame:
    """(label, dim, leaf, trees) of large leaves, each fitted on its own sampled vectors, in a task each."""

    def run(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1)
        leaf, dim, many = (one.column(c)[0].as_py() for c in ("leaf", "dim", "size"))
        vectors = _unit(table.column("v").combine_chunks().values.to_numpy().reshape(-1, dim))
        vectors = vectors[np.lexsort(vectors.T[::-1])]
        own = range(TREES) if leaf >> _TREE == TREES else [leaf >> _TREE]
        trees = {t: Tree(vectors @ _directions(dim, turn)[t].T, many / len(vectors), SPILL / np.sqrt(dim)) for t in own}
        return pa.table({**{c: one.column(c) for c in ("label", "dim", "leaf")}, "trees": pa.array([pickle.dumps(trees)], pa.binary())})

    return sample.groupBy("label", "dim", "leaf").applyInArrow(run, "label long, dim int, leaf long, trees binary")


def _split_large(placed: DataFrame, turn: int) -> DataFrame | None:
    """The placed vectors with their large leaves split once more, or None if no leaf is to be split.

    A leaf's trees travel once to each task that places its vectors, ahead of them in the sort order.
    """
    key = ["label", "dim", "leaf"]
    each = placed.select("label", "dim", F.explode("leaves").alias("leaf"))
    sizes = each.where(F.col("leaf").bitwiseAND(F.lit(1 << _DONE)) == 0).groupBy(*key).agg(F.count("*").alias("size"))
    large = checkpointed(sizes.where(F.col("size") > LARGE_LEAF).withColumn("parts", F.ceil(F.col("size") / PLACED_VECTORS).cast("int")))
    if large.isEmpty():
        return None
    rows = placed.select("class", "label", "dim", "v", F.explode("leaves").alias("leaf")).join(large, key)
    share = F.pmod(F.xxhash64("class", F.lit(turn)), F.lit(1 << 62)) / F.lit(float(1 << 62)) * F.col("size") < SAMPLE_VECTORS
    trees = checkpointed(_fit_leaves(rows.where(share).select(*key, "size", "v"), turn))
    ahead = trees.join(large, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("class"), F.lit(None).cast("array<double>").alias("v"), "trees")
    behind = rows.select(*key, F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"), "class", "v", F.lit(None).cast("binary").alias("trees"))
    order = [*key, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Tree] = {}
        for batch in batches:
            kinds, classes, vectors = (batch.column(c).to_pylist() for c in ("trees", "class", "v"))
            heads = [k for k, x in enumerate(kinds) if x is not None]
            for a, b in zip([0, *heads], [*heads, len(kinds)], strict=True):
                if a < b and kinds[a] is not None:
                    trees, a = pickle.loads(kinds[a]), a + 1
                if a < b:
                    label, dim, leaf = (batch.column(c)[a].as_py() for c in key)
                    now = _place(trees, _unit(np.array(vectors[a:b])), turn, label, dim, leaf)
                    yield pa.RecordBatch.from_arrays([pa.array(classes[a:b], pa.int64()), pa.array([leaf] * (b - a), pa.int64()), pa.array(now, pa.list_(pa.int64()))], names=["class", "leaf", "now"])

    again = ahead.unionByName(behind).repartition(*order).sortWithinPartitions(*order, F.col("class").asc_nulls_first()).mapInArrow(run, "class long, leaf long, now array<long>")
    changed = again.groupBy("class").agg(F.collect_list("leaf").alias("old"), F.flatten(F.collect_list("now")).alias("now"))  # of one vector: some leaves of five trees
    none = F.array().cast("array<long>")
    leaves = F.sort_array(F.concat(F.array_except("leaves", F.coalesce("old", none)), F.coalesce("now", none)))
    return checkpointed(placed.join(changed, "class", "left").select("class", "copies", "label", "dim", "v", leaves.alias("leaves")))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.where(F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull())
    hashed = usable.select("id", "label", "v", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",")), 256).alias("digest"))
    grouped = hashed.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    # A number of its own for each class, fixed by the checkpoint: an id may have several vectors.
    classes = checkpointed(grouped.withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    total = classes.count()
    share = F.pmod(F.xxhash64("digest"), F.lit(1 << 62)) / F.lit(float(1 << 62)) * F.lit(total) < SAMPLE_VECTORS
    picked = classes.where(share).orderBy("digest").select("label", "v").collect()  # about SAMPLE_VECTORS
    unit = [(r.label, _unit(np.array([r.v]))[0]) for r in picked]
    sent = spark.sparkContext.broadcast(Forest(unit, total / max(1, len(unit))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                vectors, labels = [np.array(v) for v in batch.column("v").to_pylist()], batch.column("label").to_pylist()
                groups: dict[tuple[int, int], list[int]] = {}
                for k, (v, label) in enumerate(zip(vectors, labels, strict=True)):
                    groups.setdefault((label, len(v)), []).append(k)
                found: list = [None] * len(vectors)
                for (label, _), own in groups.items():
                    for k, leaf in zip(own, sent.value.leaves(label, _unit(np.array([vectors[k] for k in own]))), strict=True):
                        found[k] = leaf
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "copies", "label", "dim", "v")), pa.array(found, pa.list_(pa.int64()))], names=["class", "copies", "label", "dim", "v", "leaves"])

    placed = checkpointed(classes.select("class", "copies", "label", "dim", "v").mapInArrow(place, "class long, copies long, label long, dim int, v array<double>, leaves array<long>"))
    turn = 1
    while (deeper := _split_large(placed, turn)) is not None:
        placed, turn = deeper, turn + 1
    leaf = ["label", "dim", "leaf"]
    sizes = placed.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy(*leaf).agg(F.count("*").alias("size")).where("size > 1")
    blocks = sizes.select(*leaf, F.ceil(F.col("size") / BLOCK_VECTORS).cast("int").alias("blocks"))
    each = placed.withColumn("leaf", F.explode("leaves")).join(blocks, leaf).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*leaf, "class", "copies", "v", "leaves", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("class").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, lists = ids[order], table.column("leaves").to_pylist()
        width = max(map(len, lists))
        leaves = np.array([x + [-1] * (width - len(x)) for x in lists], np.int64)[order]
        flat = table.column("v").combine_chunks()
        vectors = flat.values.to_numpy().reshape(len(ids), -1)[order]
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True) if not np.isfinite((vectors * vectors).sum(axis=1)).all() or ((vectors * vectors).sum(axis=1) < 1e-200).any() else vectors
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        counts, roots = compare(table.column("leaf")[0].as_py(), vectors, leaves, table.column("copies").to_numpy()[order], table.column("own").to_numpy()[order], cross, threshold)
        kept = (counts > 0) | (roots != np.arange(len(ids)))
        return pa.table({"class": ids[kept], "links": counts[kept], "root": ids[roots[kept]]})

    # Dealt out by pairs of blocks, whatever the partitioning before, so that no leaf is one task.
    found = checkpointed(dealt.repartition(*leaf, "i", "j").groupBy(*leaf, "i", "j").applyInArrow(run, "class long, links long, root long"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    # Two salts give the join its own exchanges, so AQE can split a vector with very many copies.
    named = classes.select("digest", "class", "copies", F.explode(F.array(F.lit(0), F.lit(1))).alias("salt"))
    owned = checkpointed(hashed.select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("salt")).join(named, ["digest", "salt"]).select("id", "class", "copies"))
    # Rows of one id belong together: its classes hang on their least.
    shared = owned.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("most")).where("b < most").select("id", "b")
    same = owned.join(shared, "id").select(F.col("class").alias("a"), "b")
    groups = connected(found.select(F.col("class").alias("a"), F.col("root").alias("b")).unionByName(same)).select(F.col("node").alias("class"), F.col("component").alias("grp"))
    member = checkpointed(classes.select("class", "first").join(groups, "class").withColumn("salt", F.pmod("class", F.lit(GROUP_SALTS)).cast("int")))
    least = member.groupBy("grp").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(GROUP_SALTS - 1))))
    known = classes.select("class", "first").join(member.join(least, ["grp", "salt"]).select("class", "component_id"), "class", "left").join(links, "class", "left")
    known = known.select("class", F.coalesce("component_id", "first").alias("component_id"), "links", F.explode(F.array(F.lit(0), F.lit(1))).alias("salt"))
    linked = owned.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")).join(known, ["class", "salt"]).select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    others = rows.where(~(F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(others)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH u AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept
FROM (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY a)"""
ORACLE = ORACLE.replace("WITH u", "WITH RECURSIVE u")
