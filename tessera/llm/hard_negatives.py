"""Hard negatives by product quantisation with stored residual norms.

Vectors become integers first, so scores are exact.  Each is coded as one of 256 centres in every pair of its
components, and keeps the norm of what the centres leave.  A score is then the sum of one entry a pair from
the anchor's lookup table, give or take the anchor's norm times that residual norm: bounds that hold for
certain, rounding included.  Only rows whose bounds reach what has already been secured are scored again,
exactly, in integers; that completes each window.

Two passes, each over cells of one block of anchors and one block of rows, so that no label, however
large, is one task: the first takes an anchor's best rows of its own label (its positives), the second, for
the window of scores below each positive, the best rows of other labels.  A cell returns the few best
rows of each window, and the best of those are taken over all cells.  The centres are fitted on a sample of
about ``SAMPLE_VALUES`` components; every row is coded, and a poor fit costs time, never a result.

Defined cases: rows of null id or label, and vectors that are null or hold null or non-finite components, take no
part; vectors of different length are not compared; a vector whose integers have a squared length of
2^62 or more takes no part, as its scores have no long; the rows of an anchor's own id are neither its positives
nor its negatives; repeated rows are rows each (an anchor listed twice is answered twice, with equal rows); ties
go to the smaller id; labels are compared as text; an empty table, or one without anchors, gives an empty
result; only the id, label and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.llm.common import BROADCAST_LABELS
from tessera.llm.graph import checkpointed

#: Components that share a code, and centres of each.
WIDTH, CENTRES = 2, 256
#: Components of the vectors that centres are fitted on, and steps of the fit.
SAMPLE_VALUES, FIT_STEPS = 8192 * 64, 6
#: Rows and anchors of a cell; anchors whose tables are held at once.
ROW_BLOCK, ANCHOR_BLOCK, TOGETHER = 32_768, 1024, 64
#: Squared length from which a score need not fit a long.
TOO_LONG = float(1 << 62)
#: Parts in which a label's numbers of blocks go to its rows.
SALTS = 16


def integers(vector: list[float], scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(scale * np.array(vector, float))


def answerable(x: np.ndarray) -> np.ndarray:
    """Whether scores of these vectors (along the last axis) fit a long."""
    with np.errstate(over="ignore"):
        return (x * x).sum(axis=-1) < TOO_LONG


class Codes:
    """Centres by length of vector."""

    def __init__(self, sample: list[np.ndarray]) -> None:
        self.centres: dict[int, np.ndarray] = {}
        groups: dict[int, list[np.ndarray]] = {}
        for x in sample:
            groups.setdefault(len(x), []).append(x)
        for dim, vectors in groups.items():
            self.centres[dim] = self._fit(_pairs(np.array(vectors)))

    @staticmethod
    def _fit(x: np.ndarray) -> np.ndarray:
        """(pair, centre, component) by alternating assignment and means, from sampled points."""
        n, many, _ = x.shape
        start = np.random.default_rng(n).permutation(n)[:CENTRES]
        out = np.zeros((many, CENTRES, WIDTH))
        for m in range(many):
            own = x[:, m]
            centres = own[start]
            for _ in range(FIT_STEPS):
                nearest = _nearest(own, centres)
                count = np.bincount(nearest, minlength=len(centres))
                total = np.stack([np.bincount(nearest, weights=own[:, c], minlength=len(centres)) for c in range(WIDTH)], axis=1)
                centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
            out[m, : len(centres)] = centres
            out[m, len(centres) :] = centres[0]
        return out

    def of(self, dim: int) -> np.ndarray:
        """Without a sampled vector of this length, one centre: nothing."""
        return self.centres.get(dim, np.zeros((-(-dim // WIDTH), 1, WIDTH)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors of one length, and by how much of an anchor's norm their scores can be off."""
        centres, parts = self.of(x.shape[1]), _pairs(x)
        codes = np.zeros(parts.shape[:2], np.uint8)
        for m in range(parts.shape[1]):
            codes[:, m] = _nearest(parts[:, m], centres[m])
        near = centres[np.arange(parts.shape[1]), codes]
        residual = np.sqrt(((parts - near) ** 2).sum(axis=(1, 2)))
        # Tables, their sums and the bounds are single floats: each step is off by 2^-24 of the terms at most.
        rounding = (parts.shape[1] + 8) * 2.0**-23 * (np.sqrt((near**2).sum(axis=(1, 2))) + residual)
        return codes, residual * (1 + 2.0**-20) + rounding


def _pairs(x: np.ndarray) -> np.ndarray:
    """(vector, pair, component), filled up with zeros."""
    many = -(-x.shape[1] // WIDTH)
    out = np.zeros((len(x), many * WIDTH))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), many, WIDTH)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T), axis=1)


class Cell:
    """The rows of a cell with their codes, and the anchors that are scored against them."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, dim: int, centres: np.ndarray) -> None:
        self.ids, self.slack = rows.column("id").to_numpy(), rows.column("slack").to_numpy()
        self.q, self.codes = _matrix(rows, "q", np.int32, dim), _matrix(rows, "codes", np.uint8, len(centres))
        self.anchor_ids, self.anchor_rows = anchors.column("id").to_numpy(), anchors.column("row").to_numpy()
        self.a, self.centres = _matrix(anchors, "q", np.int32, dim).astype(np.int64), centres
        self.norm = np.sqrt((self.a.astype(float) ** 2).sum(axis=1))

    def bounds(self) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
        """For some anchors at a time: lower and upper bounds of their scores, (row, anchor)."""
        codes = np.ascontiguousarray(self.codes.T)
        for start in range(0, len(self.a), TOGETHER):
            own = range(start, min(len(self.a), start + TOGETHER))
            table = np.einsum("mkc,amc->mka", self.centres, _pairs(self.a[own].astype(float))).astype(np.float32)
            score = np.zeros((len(self.ids), len(own)), np.float32)
            for at in range(0, len(self.ids), 4096):
                for m in range(len(table)):
                    score[at : at + 4096] += table[m].take(codes[m, at : at + 4096], axis=0)
            off = (self.slack[:, None] * self.norm[own][None, :]).astype(np.float32)
            yield own, score - off, score + off

    def exact(self, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Integer scores of pairs."""
        parts = [np.einsum("nd,nd->n", self.q[rows[k : k + 65_536]].astype(np.int64), self.a[anchors[k : k + 65_536]]) for k in range(0, len(rows), 65_536)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def best(self, group: np.ndarray, rows: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """Which of the scored pairs are the best ``most`` of their group."""
        order = np.lexsort((self.ids[rows], -scores, group))
        ordered = group[order]
        place = np.arange(len(order)) - np.searchsorted(ordered, ordered, side="left")
        return order[place < most]


def _matrix(table: pa.Table, column: str, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind).reshape(table.num_rows, width)


def _blocks(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_blocks, anchor_blocks) of groups that have anchors."""
    summed = counts.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("anchors").alias("anchors")).where("anchors > 0")
    return summed.select(*keys, F.ceil(F.col("rows") / ROW_BLOCK).cast("int").alias("row_blocks"), F.ceil(F.col("anchors") / ANCHOR_BLOCK).cast("int").alias("anchor_blocks"))


def _dealt(rows: DataFrame, blocks: DataFrame, keys: list[str], few: bool, anchors: bool) -> DataFrame:
    """Rows with the cells that they go to: each to one block of its kind and all of the other."""
    if few:
        known = rows.join(F.broadcast(blocks), keys)
    else:  # a label may hold a third of all rows
        salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")
    own, other = ("anchor_blocks", "row_blocks") if anchors else ("row_blocks", "anchor_blocks")
    i, j = ("i", "j") if anchors else ("j", "i")
    return known.withColumn(i, F.pmod(F.xxhash64("row"), F.col(own)).cast("int")).withColumn(j, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("row_blocks", "anchor_blocks")


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor``: a condition on the id column of ``df``.  An anchor's positives are its best
    ``positives`` other rows of its label; for each, the best ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score are returned.
    """
    context = df.sparkSession.sparkContext
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), is_anchor.alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    values = usable.agg(F.sum(F.size("v"))).first()[0] or 0
    share = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 62)) / F.lit(float(1 << 62)) * F.lit(values) < SAMPLE_VALUES
    picked = [integers(v, scale) for v in usable.where(share).select("v").toArrow().column(0).to_pylist()]  # about SAMPLE_VALUES numbers
    sent = context.broadcast(Codes(sorted(filter(answerable, picked), key=tuple)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                vectors = [integers(v, scale) for v in batch.column("v").to_pylist()]
                lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
                for dim in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == dim)
                    x = np.array([vectors[k] for k in own]).reshape(len(own), dim)
                    fits = answerable(x)
                    own, x = own[fits], x[fits]
                    codes, slack = sent.value.encode(x)
                    q = x.astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(own)) for c in ("id", "label", "anchor")), pa.array([dim] * len(own), pa.int32()), pa.array([r.tobytes() for r in q], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(slack, pa.float64())], names=["id", "label", "anchor", "dim", "q", "codes", "slack"])

    # A number of its own for each row, fixed by the checkpoint: an id may have several rows.
    coded = checkpointed(usable.mapInArrow(encode, "id long, label string, anchor boolean, dim int, q binary, codes binary, slack double").withColumn("row", F.monotonically_increasing_id()))
    counts = checkpointed(coded.groupBy("dim", "label").agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")))
    few = counts.count() <= BROADCAST_LABELS
    columns = ["id", "label", "q", "codes", "slack"]
    anchors = coded.where("anchor").select(*(F.col(c).alias(c) for c in ("row", "id", "label", "dim", "q")))  # columns of their own, as both sides of a cell come from one table

    def near(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            cell = Cell(right, left, dim, sent.value.of(dim))
            for own, lower, upper in cell.bounds():
                same = cell.ids[:, None] == cell.anchor_ids[own][None, :]
                lower[same], upper[same] = -np.inf, -np.inf
                least = np.partition(lower, -positives, axis=0)[-positives] if len(lower) > positives else np.full(len(own), -np.inf)
                row, anchor = np.nonzero((upper >= least[None, :]) & ~same)
                anchor = anchor + own.start
                score = cell.exact(row, anchor)
                kept = cell.best(anchor, row, score, positives)
                found.append((cell.anchor_rows[anchor[kept]], cell.ids[row[kept]], score[kept]))
        return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]), pa.int64()) for k, n in enumerate(("row", "positive_id", "positive_score"))})

    by_label = ["dim", "label"]
    blocks = _blocks(counts, by_label)
    cells = [*by_label, "i", "j"]
    first = _dealt(anchors, blocks, by_label, few, True).groupBy(*cells).cogroup(_dealt(coded.select("row", "dim", *columns), blocks, by_label, few, False).groupBy(*cells))
    order = W.Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    ranked = first.applyInArrow(near, "row long, positive_id long, positive_score long").withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    windows = ranked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))  # ``positives`` at most

    def below(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            cell = Cell(right, left, dim, sent.value.of(dim))
            number = {x: k for k, x in enumerate({*left.column("label").to_pylist(), *right.column("label").to_pylist()})}
            labels, own_label = (np.fromiter(map(number.__getitem__, t.column("label").to_pylist()), np.int64, t.num_rows) for t in (right, left))
            given = left.column("positives").to_pylist()
            for own, lower, upper in cell.bounds():
                for a in own:
                    wanted = [(p, -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in given[a]]
                    wanted = [(p, least, most) for p, least, most in wanted if least <= most]
                    if not wanted:
                        continue
                    u, v = upper[:, a - own.start], lower[:, a - own.start]
                    some = np.flatnonzero((u >= min(w[1] for w in wanted)) & (v <= max(w[2] for w in wanted)) & (labels != own_label[a]) & (cell.ids != cell.anchor_ids[a]))
                    u, v = u[some], v[some]
                    masks = []
                    for _, least, most in wanted:
                        sure = v[(u <= most) & (v >= least)]
                        secured = np.partition(sure, -negatives)[-negatives] if len(sure) > negatives else least
                        masks.append((v <= most) & (u >= max(secured, least)))
                    asked = np.flatnonzero(np.any(masks, axis=0))
                    row = some[asked]
                    score = cell.exact(row, np.full(len(row), a))
                    for p, least, most in wanted:
                        inside = np.flatnonzero((score >= least) & (score <= most))
                        kept = inside[cell.best(np.zeros(len(inside), np.int64), row[inside], score[inside], negatives)]
                        many = len(kept)
                        found.append(([cell.anchor_rows[a]] * many, [cell.anchor_ids[a]] * many, [p["place"]] * many, [p["positive_id"]] * many, [p["positive_score"]] * many, cell.ids[row[kept]], score[kept]))
        names = ("row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]).astype(np.int64), pa.int64()) for k, n in enumerate(names)})

    blocks = _blocks(counts, ["dim"])
    cells = ["dim", "i", "j"]
    asking = _dealt(anchors.join(windows, "row"), blocks, ["dim"], few, True)
    second = asking.groupBy(*cells).cogroup(_dealt(coded.select("row", "dim", *columns), blocks, ["dim"], few, False).groupBy(*cells))
    order = W.Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ended = second.applyInArrow(below, "row long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    return ended.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH u AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CASE WHEN len(a.q) = 0 THEN 0 ELSE list_dot_product(a.q, b.q) END::BIGINT AS score
  FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INT AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id) WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3"""
