"""Toxicity by maximum-scoring segments of token log-odds.

Every token has a log-odds of toxic against clean text.  Counts are smoothed by nested Dirichlet
priors: a word's prior is what its prefixes of 6, 5, 4 and 3 letters say, so that inflected forms of a
toxic stem count though they were never seen.  Tokens of no evidence score a constant below zero.  A
linear-time scan (all maximal scoring subsequences) finds every passage of positive sum; by extreme-
value statistics a passage of score S in a text of n tokens is expected ``K n exp(-lambda S)`` times
by chance, where lambda solves ``sum p exp(lambda s) = 1`` over clean tokens.  A document's score is a
logistic function, fitted on the same sample, of its passages' expectations.

Defined cases: null and empty texts have no token and get the score of a text without evidence;
without labelled rows of both kinds every score is 0; several labels of a document count as the
highest; texts are scanned whole, of any length; equal passages are all found; repeated rows give
equal results; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import jaccard
from tessera.llm.common import bounded_sample, in_training, set_aside, slices, worker_state
from tessera.llm.graph import checkpointed

#: Distinct labelled texts of each class that the model learns from.
SAMPLE_TEXTS = 6000
#: Prefix lengths of the nested priors; weight of each prior; least toxic texts of a feature.
PREFIXES, PRIOR_WEIGHT, LEAST_TEXTS = (3, 4, 5, 6), 4.0, 3
#: Toxic texts that share so many per cent of their runs of so many words count as one text.
COPY_WORDS, COPY_PERCENT = 5, 80
#: A prefix speaks for words that were not seen only if no one continuation has a larger part of it.
MOST_SHARE = 0.6
#: Taken from every token's log-odds, so that a passage must pay for its tokens.
DRIFT = 0.7
#: Log-odds, after drift, from which a token has evidence.
EVIDENCE = 1.5
#: Expected number of chance passages below which a passage is significant.
SIGNIFICANT = 0.01
KARLIN_K = 0.1
#: Length that the shortest texts count as, and length that a text without any passage counts as.
LEAST_TOKENS, NO_PASSAGE_TOKENS = 100, 10_000
THRESHOLD = 0.3
#: Features that a task counts before it passes them on.
COUNTED = 300_000
#: Words whose scores a worker remembers, and their greatest length (longer ones are scored anew).
MEMO_WORDS, MEMO_LENGTH = 300_000, 64
_WORDS = re.compile(r"[^\W\d_]+").findall
_SPANS = re.compile(r"[^\W\d_]+").finditer


def features(word: str) -> list[str]:
    """The chain of a word: its prefixes, marked, from short to long, then the word."""
    return [word[:n] + "*" for n in PREFIXES if len(word) >= n] + [word]


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)  # of features with evidence, before drift
    lam: float = 1.0
    intercept: float = -20.0
    slope: float = 0.0

    def __post_init__(self) -> None:
        self.memo: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, memo={})

    def token(self, word: str) -> float:
        """Score of a token: the longest feature with evidence speaks for it, less the drift."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            found = next((self.odds[f] for f in reversed(features(word)) if f in self.odds), 0.0) - DRIFT
            if len(word) <= MEMO_LENGTH:
                self.memo[word] = found
        return found

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal scoring subsequences as (first token, past the last, sum).

        Each one found links to the nearest earlier one with a smaller sum before it.  Searches follow
        these links: what a search passes over, no later one meets again, so the scan is linear.
        """
        out: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum with, link
        total, last = 0.0, 0
        for i in np.nonzero(scores > 0)[0].tolist():
            total += float(i - last) * -DRIFT
            before, total, last = total, total + float(scores[i]), i + 1
            first, k = i, len(out) - 1
            while True:
                while k >= 0 and out[k][2] >= before:
                    k = out[k][4]
                if k < 0 or out[k][3] >= total:
                    out.append((first, last, before, total, k))
                    break
                first, _, before, _, link = out[k]
                del out[k:]
                k = link
        return [(a, b, y - x) for a, b, x, y, _ in out]

    def bits(self, score: float, n: int) -> float:
        """-log of the passages of this score that chance gives in n tokens."""
        return self.lam * score - math.log(KARLIN_K * max(n, LEAST_TOKENS))

    def evidence(self, scores: np.ndarray) -> float:
        """Of a document: the sum over its significant passages, else the best passage's."""
        found = [self.bits(s, len(scores)) for _, _, s in self.passages(scores)]
        if not found:
            return -math.log(KARLIN_K * NO_PASSAGE_TOKENS)
        least = -math.log(SIGNIFICANT)
        strong = [x for x in found if x >= least]
        return sum(strong) if strong else max(found)

    def scores(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.token, words), np.float64, len(words))

    def probability(self, evidence: float) -> float:
        z = self.intercept + self.slope * min(max(evidence, -40.0), 40.0)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def score(self, text: str | None) -> float:
        return self.probability(self.evidence(self.scores(_WORDS(text.lower()) if text else [])))

    def spans(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant passages as character ranges with their expectation's -log."""
        places = list(_SPANS(text)) if text else []
        found = self.passages(self.scores([m[0].lower() for m in places]))
        return [(places[a].start(), places[b - 1].end(), bits) for a, b, s in found if (bits := self.bits(s, len(places))) >= -math.log(SIGNIFICANT)]


def _grouped(sample: DataFrame) -> DataFrame:
    """The sample with ``copies``, for toxic texts the near-copy group that they count as one text of."""
    toxic = checkpointed(sample.where("label = 1").select(F.xxhash64("text").alias("id"), "text"))
    groups = jaccard.near_groups(toxic, "id", width=COPY_WORDS, percent=COPY_PERCENT).groupBy("id").agg(F.min("component_id").alias("copies"))
    named = toxic.join(groups, "id").select("text", F.lit(1).alias("label"), "copies")
    return checkpointed(sample.where("label = 0").withColumn("copies", F.lit(None).cast("long")).unionByName(named))


def _count(sample: DataFrame) -> DataFrame:
    """(feature, toxic texts, clean texts) with partial counts before the shuffle.

    Near copies of one toxic text count once, so that they do not make all their words toxic.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter = Counter()
        pairs: set[tuple[str, int]] = set()

        def counted() -> Iterator[pa.RecordBatch]:
            for rows in ([(f, c, 0) for f, c in pairs], [(f, None, n) for f, n in clean.items()]):
                for i in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 50_000], strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["feature", "copies", "clean"])
            pairs.clear()
            clean.clear()

        for whole in batches:
            for batch in slices(whole, 0):
                for text, label, copies in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    found = {f for w in set(_WORDS(text.lower())) for f in features(w)}
                    if label:
                        pairs.update((f, copies) for f in found)
                    else:
                        clean.update(found)
                    if len(pairs) + len(clean) > COUNTED:
                        yield from counted()
        yield from counted()

    each = sample.select("text", "label", "copies").mapInArrow(run, "feature string, copies long, clean long")
    by_pair = each.groupBy("feature", "copies").agg(F.sum("clean").alias("clean"))
    return by_pair.groupBy("feature").agg(F.count("copies").alias("toxic"), F.sum("clean").alias("clean"))


def _odds(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> tuple[dict[str, float], float]:
    """Log-odds of features with evidence, and how often clean text has one."""
    seen = {f: (t, c) for f, t, c in rows}
    largest: dict[str, int] = {}  # of what continues a prefix, and the sum of it
    together: dict[str, int] = {}
    for f, (t, _) in seen.items():
        chain = features(f.rstrip("*"))
        if above := chain[: chain.index(f)]:
            largest[above[-1]] = max(largest.get(above[-1], 0), t)
            together[above[-1]] = together.get(above[-1], 0) + t
    out: dict[str, float] = {}
    clean_hits = 0
    for feature, (t, c) in sorted(seen.items(), key=lambda x: (not x[0].endswith("*"), len(x[0]), x[0])):
        share = 0.5
        for f in features(feature.rstrip("*")):
            toxic, clean = seen.get(f, (0, 0))
            a, b = toxic / n_toxic, clean / n_clean
            weight = PRIOR_WEIGHT / n_toxic
            share = (a + weight * share) / (a + b + weight)
            if f == feature:
                break
        odds = math.log(share / (1 - share)) if 0 < share < 1 else 0.0
        if t >= LEAST_TEXTS and odds - DRIFT >= EVIDENCE and (not feature.endswith("*") or largest.get(feature, 0) <= MOST_SHARE * max(t, together.get(feature, 0))):
            out[feature] = odds
            clean_hits += c
    return out, (clean_hits + 0.5) / (n_clean + 1)


def _lambda(odds: dict[str, float], rate: float) -> float:
    """Positive root of sum p exp(lambda s) = 1 for clean tokens: ``rate`` with evidence, others drift."""
    top = max(odds.values(), default=1.0) - DRIFT
    p = min(max(rate / 300, 1e-6), 0.2)  # texts to tokens
    lo, hi = 1e-3, 50.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if p * math.exp(min(mid * top, 600)) + (1 - p) * math.exp(-mid * DRIFT) > 1:
            hi = mid
        else:
            lo = mid
    return lo


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps with a small ridge; the slope is not below zero."""
    x = np.clip(x, -40, 40)
    X = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (p - y) + 1e-3 * w
        h = (X * (p * (1 - p))[:, None]).T @ X + np.eye(2) * 1e-3
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on a bounded sample of labelled rows that are not held out."""
    marks = labels.where(F.col(label_col).isNotNull() & in_training(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    sample = bounded_sample(rows, "id", "body", "label", SAMPLE_TEXTS, marks)
    sample = _grouped(checkpointed(sample.select("text", (F.col("label") > 0).cast("int").alias("label"))))
    totals = dict(sample.groupBy("label").agg(F.when(F.col("label") == 1, F.countDistinct("copies")).otherwise(F.count("*"))).collect())
    model = Model()
    if not totals.get(0) or not totals.get(1):
        return model
    share = PRIOR_WEIGHT / (PRIOR_WEIGHT + LEAST_TEXTS)  # what a feature needs at least, before the exact test
    counted = _count(sample).where((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") / totals[1] * share > F.col("clean") / totals[0]) | F.col("feature").endswith("*"))
    model.odds, rate = _odds([tuple(r) for r in counted.collect()], totals[1], totals[0])
    model.lam = _lambda(model.odds, rate)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for batch in slices(whole, 0):
                found = [own.evidence(own.scores(_WORDS(t.lower()))) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], names=["x", "label"])

    pairs = sample.mapInArrow(evidence, "x double, label int").collect()
    y = np.array([r.label for r in pairs], float)
    model.intercept, model.slope = _logistic(np.array([r.x for r in pairs]), y)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", *, spans: bool = False) -> DataFrame:
    """``docs`` with toxicity (and toxic_spans); one pass, no shuffle."""
    own = ["toxicity", *(["toxic_spans"] if spans else [])]
    kept = [c for c in docs.columns if c not in own]
    at = kept.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = sent.value
        worker.memo = worker_state(("toxicity", worker.lam, worker.intercept), dict)
        for whole in batches:
            for batch in slices(whole, at):
                texts = batch.column(at).to_pylist()
                added = [pa.array([worker.score(t) for t in texts], pa.float64())]
                if spans:
                    added.append(pa.array([[{"start": a, "end": b, "bits": x} for a, b, x in worker.spans(t)] for t in texts], span_type))
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*kept, *own])
        worker.memo = {}  # what is kept is the worker's

    fields = [T.StructField("toxicity", T.DoubleType())]
    if spans:
        fields.append(T.StructField("toxic_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("bits", T.DoubleType())]))))
    return docs.select(*kept).mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *fields]))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose toxicity is below the threshold, with their own columns."""
    fed, restore = set_aside(docs, ("toxicity",))
    return restore(score(fed, model, text_col).where(F.col("toxicity") < threshold))
