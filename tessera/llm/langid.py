"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of each letter run (with a blank on either side) in both directions and
labels every position; a document pools the positions' log-probabilities, each run as one vote.  It
is trained here, in numpy, by backpropagation through time, on a bounded sample of labelled texts, each
of them whole and with all its runs.
A run's labels depend on its bytes alone, so a worker reads each distinct run once and remembers it.

Defined cases: null texts, and texts without a letter, are ``und`` with score 0; without any labelled
text to learn from all documents are ``und``; runs over ``RUN_BYTES`` are read in pieces, all of them;
equal probabilities choose the first language in order; repeated rows give equal results; an empty
table gives an empty result; only the id, text and (to learn) language columns are read.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded_sample, in_training, set_aside, slices, worker_state

UND = "und"
#: Of a known language: what its runs' sureness has to reach, of the way from chance to certainty.
LEAST_SURE = 0.2
#: Bound of the training sample: distinct texts of a language.
SAMPLE_TEXTS = 300
HIDDEN, EMBEDDED, EPOCHS, BATCH, RATE = 16, 12, 2, 512, 0.015
#: Steps of training at least; few runs are passed over more often.
LEAST_STEPS = 120
#: Longest piece of a run; runs that a worker remembers, and their length in all.
RUN_BYTES, MEMO_RUNS, MEMO_LENGTH = 48, 250_000, 8 << 20
_RUNS = re.compile(r"[^\W\d_]+").findall
_SPANS = re.compile(r"[^\W\d_]+").finditer


def pieces(run: str) -> list[bytes]:
    raw = run.encode("utf-8", "surrogatepass")
    return [raw[i : i + RUN_BYTES] for i in range(0, len(raw), RUN_BYTES)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters: byte embedding E; per direction W (input), U (recurrent), b; output V, c."""

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        h, e = HIDDEN, EMBEDDED
        self.langs = langs
        self.p = {"E": draw.normal(0, 0.3, (256, e)), "V": draw.normal(0, 0.3, (2 * h, len(langs))), "c": np.zeros(len(langs))}
        for d in "fb":
            self.p |= {f"W{d}": draw.normal(0, e**-0.5, (e, 3 * h)), f"U{d}": draw.normal(0, h**-0.5, (h, 3 * h)), f"b{d}": np.zeros(3 * h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.temperature = 1.0

    def _direction(self, inputs: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each step for inputs (steps, words, 3 * hidden)."""
        h, U = HIDDEN, self.p[f"U{d}"]
        state = np.zeros((inputs.shape[1], h), np.float32)
        states, tape = np.empty((*inputs.shape[:2], h), np.float32), []
        for t in range(len(inputs)):
            a = state @ U
            zr = _sigmoid(inputs[t, :, : 2 * h] + a[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(inputs[t, :, 2 * h :] + r * a[:, 2 * h :])
            if keep:
                tape.append((state, z, r, n, a[:, 2 * h :]))
            state = n + z * (state - n)
            states[t] = state
        return states, tape

    def forward(self, codes: np.ndarray, keep: bool = False):
        """Log-probabilities (steps, words, languages) for byte codes (words, steps)."""
        turned = codes.T
        x = self.p["E"][turned] if keep else None
        tables = {d: self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}
        forth, tape_f = self._direction(tables["f"][turned], "f", keep)
        back, tape_b = self._direction(tables["b"][turned[::-1]], "b", keep)
        both = np.concatenate([forth, back[::-1]], axis=2)
        out = both @ self.p["V"] + self.p["c"]
        out -= out.max(axis=2, keepdims=True)
        out -= np.log(np.exp(out).sum(axis=2, keepdims=True))
        return (out, both, tape_f, tape_b, x, turned) if keep else out

    def gradients(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions to each word's target, and its gradients through time."""
        logp, both, tape_f, tape_b, x, turned = self.forward(codes, keep=True)
        scale = (weight / (weight.sum() * len(logp))).astype(np.float32)[None, :, None]
        loss = float(-(logp * target[None] * scale).sum())
        d_out = (np.exp(logp) - target[None]) * scale
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        h = HIDDEN
        g["V"] = both.reshape(-1, 2 * h).T @ d_out.reshape(-1, d_out.shape[2])
        g["c"] = d_out.sum(axis=(0, 1))
        d_both = d_out @ self.p["V"].T
        d_x = np.zeros_like(x)
        for d, tape, d_states, order in (("f", tape_f, d_both[:, :, :h], range(len(x))), ("b", tape_b, d_both[::-1, :, h:], range(len(x) - 1, -1, -1))):
            U, W = self.p[f"U{d}"], self.p[f"W{d}"]
            at = list(order)
            carried = np.zeros_like(tape[0][0])
            for t in range(len(x) - 1, -1, -1):
                before, z, r, n, a_n = tape[t]
                ds = d_states[t] + carried
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (before - n) * z * (1 - z)
                dr = dn * a_n * r * (1 - r)
                d_in = np.concatenate([dz, dr, dn], axis=1)
                d_a = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"U{d}"] += before.T @ d_a
                g[f"W{d}"] += x[at[t]].T @ d_in
                g[f"b{d}"] += d_in.sum(axis=0)
                d_x[at[t]] += d_in @ W.T
                carried = ds * z + d_a @ U.T
        for k in range(EMBEDDED):
            g["E"][:, k] = np.bincount(turned.reshape(-1), d_x[:, :, k].reshape(-1), 256)
        return loss, g

    def run_logs(self, words: list[bytes]) -> np.ndarray:
        """Each word's mean log-probability over its own positions."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            for at in np.array_split(found := np.nonzero(lengths == n)[0], -(-len(found) // 4096)):
                logp = self.forward(_codes([words[i] for i in at], int(n)))
                out[at] = logp[1:-1].mean(axis=0)
        return out

    def positions(self, word: bytes) -> np.ndarray:
        """The language index of every byte."""
        return self.forward(_codes([word], len(word)))[1:-1, 0].argmax(axis=1)


def _codes(words: list[bytes], n: int) -> np.ndarray:
    return np.frombuffer(b"".join([b" " + w + b" " for w in words]), np.uint8).reshape(len(words), n + 2).astype(np.int64)


def fit(texts: list[tuple[str, str]]) -> Network:
    """Trains on (text, language) pairs; each distinct run's target is how the languages share it."""
    langs = sorted({lang for _, lang in texts})
    net = Network(langs)
    if not langs:
        return net
    counts: list[Counter] = [Counter() for _ in langs]
    for text, lang in texts:
        for run in _RUNS(text.lower()):
            counts[langs.index(lang)].update(pieces(run))
    totals = [max(1, sum(c.values())) for c in counts]
    runs = sorted(set().union(*counts), key=lambda w: (-sum(c[w] / t for c, t in zip(counts, totals, strict=True)), w))
    share = np.array([[c[w] / t for c, t in zip(counts, totals, strict=True)] for w in runs], np.float32).reshape(len(runs), len(langs))
    weight = np.sqrt(share.sum(axis=1))
    target = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-12)
    draw = np.random.default_rng(11)
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    batches = []
    for n in np.unique(lengths):
        own = draw.permutation(np.nonzero(lengths == n)[0])
        batches += [own[i : i + BATCH] for i in range(0, len(own), BATCH)]
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, len(batches))))
    step, steps = 0, epochs * len(batches)
    for _ in range(epochs):
        for k in draw.permutation(len(batches)):
            own = batches[k]
            _, g = net.gradients(_codes([runs[i] for i in own], int(lengths[own[0]])), target[own], weight[own])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate, step = RATE * (1 - step / steps) + 1e-4, step + 1
            for key, x in g.items():  # Adam
                x = x / max(1.0, norm)
                m[key] += 0.1 * (x - m[key])
                v[key] += 0.01 * (x * x - v[key])
                net.p[key] -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-6)
    net.temperature = _temperature(net, texts)
    return net


def _temperature(net: Network, texts: list[tuple[str, str]]) -> float:
    """What divides a document's summed logs so that scores are probabilities, on the same sample."""
    reader = Reader(net)
    sums = [(s, net.langs.index(lang)) for (text, lang), s in zip(texts, [s for i in range(0, len(texts), 100) for s in reader.sums([t for t, _ in texts[i : i + 100]])], strict=True) if s is not None]
    if not sums:
        return 1.0
    x, y = np.array([s for s, _ in sums]), np.array([k for _, k in sums])
    best = (np.inf, 1.0)
    for temperature in 2.0 ** np.arange(0, 8):
        z = x / temperature
        z = z - z.max(axis=1, keepdims=True)
        loss = float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean())
        best = min(best, (loss, float(temperature)))
    return best[1]


class Reader:
    """Applies a network to texts, with a memo of runs; one a worker process."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.young: dict[str, int] = {}
        self.held = 0
        self.logs = np.zeros((0, len(net.langs)), np.float32)
        self.sure = np.zeros(0, np.float32)  # probability of each run's likeliest language

    def _learn(self, runs: set[str]) -> None:
        """Runs without a letter (other numerals that regular expressions take for one) get row 0."""
        if self._full(runs) or not len(self.logs):
            self.young, self.held, self.logs = {}, 0, np.zeros((1, len(self.net.langs)), np.float32)
        self.held += sum(map(len, runs))
        new = sorted(r for r in runs if any(map(str.isalpha, r)))
        cut = [pieces(r) for r in new]
        each = self.net.run_logs([p for c in cut for p in c])
        if new:
            starts = np.cumsum([0, *(len(c) for c in cut[:-1])])
            weight = np.fromiter((len(p) for c in cut for p in c), np.float32)
            summed = np.add.reduceat(each * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
            self.young.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
            self.logs = np.concatenate([self.logs, summed])
            self.sure = np.exp(self.logs.max(axis=1))
        self.young.update(dict.fromkeys(runs.difference(new), 0))

    def _full(self, new: set[str]) -> bool:
        return len(self.young) + len(new) > MEMO_RUNS or self.held + sum(map(len, new)) > MEMO_LENGTH

    def sums(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Each text's summed logs, or None if it has no letter."""
        return [x and x[0] for x in self.pooled(texts)]

    def pooled(self, texts: list[str | None]) -> list[tuple[np.ndarray, float] | None]:
        """Each text's summed logs and how sure its runs are on average, or None if it has no letter."""
        runs = [_RUNS(t.lower()) if t else [] for t in texts]
        new = set().union(*runs).difference(self.young)
        if new:
            if self._full(new):
                new = set().union(*runs)
            self._learn(new)
        out = []
        for r in runs:
            at = np.fromiter(map(self.young.__getitem__, r), np.int64, len(r))
            at = at[at > 0]
            out.append((self.logs[at].sum(axis=0, dtype=np.float64), float(self.sure[at].mean())) if len(at) else None)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, its probability, how sure the runs are) of each text."""
        if not self.net.langs:
            return [(UND, 0.0, float(any(map(str.isalpha, t or "")))) for t in texts]
        out = []
        for found in self.pooled(texts):
            if found is None:
                out.append((UND, 0.0, 0.0))
            else:
                s, sure = found
                k = int(s.argmax())
                z = np.exp((s - s[k]) / self.net.temperature)
                out.append((self.net.langs[k], float(1 / z.sum()), sure))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Byte ranges of one language: neighbouring positions of letter runs with the same label."""
        out: list[list] = []
        if not text or not self.net.langs:
            return []
        for m in _SPANS(text):
            if not any(map(str.isalpha, m[0])):
                continue
            at = len(text[: m.start()].encode("utf-8", "surrogatepass"))
            for piece in pieces(m[0]):
                for k in self.net.positions(piece.lower()).tolist():
                    lang = self.net.langs[k]
                    if out and out[-1][2] == lang and (out[-1][1] == at or not any(map(str.isalpha, text.encode("utf-8", "surrogatepass")[out[-1][1] : at].decode("utf-8", "ignore")))):
                        out[-1][1] = at + 1
                    else:
                        out.append([at, at + 1, lang])
                    at += 1
        return [tuple(x) for x in out]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Trains on a bounded sample of the rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang")).where(in_training(F.col("id")))
    sample = bounded_sample(rows, "id", "body", "lang", SAMPLE_TEXTS)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = {(t, lang) for b in batches for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(texts)))], pa.binary())], names=["net"])

    # In one task, as the sample is bounded: a worker's arrays use one thread, which small ones want.
    trained = sample.repartition(1).mapInArrow(train, "net binary").first()
    return pickle.loads(trained[0]) if trained else fit([])


def predict(docs: DataFrame, net: Network, text_col: str = "text", *, spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_sure (and lang_spans); one pass, no shuffle.

    ``lang_sure`` is the mean probability of each run's likeliest language: near chance where no
    language fits, high in a text of two.  It is 0 without a letter, and 1 if nothing was learned.
    """
    own = ["lang_pred", "lang_score", "lang_sure", *(["lang_spans"] if spans else [])]
    kept = [c for c in docs.columns if c not in own]
    at = kept.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast((hash(net.p["V"].tobytes()), net))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, network = sent.value
        reader = worker_state(("langid", key), lambda: Reader(network))
        for whole in batches:
            for batch in slices(whole, at):
                texts = batch.column(at).to_pylist()
                found = reader.predict(texts)
                added = [pa.array(x, kind) for x, kind in zip(zip(*found), (pa.string(), pa.float64(), pa.float64()), strict=True)]
                if spans:
                    added.append(pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in reader.spans(t)] for t in texts], span_type))
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*kept, *own])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_sure", T.DoubleType())]
    if spans:
        fields.append(T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))))
    return docs.select(*kept).mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *fields]))


def keep_known(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The documents in whose letters the network sees a language it knows.

    Rejected are null texts, texts without a letter, and texts whose runs are sure of no language: on
    average less than ``LEAST_SURE`` of the way from chance to certainty.  If there was nothing to learn
    from, only the first two kinds are.
    """
    chance = 1 / max(1, len(net.langs))
    least = chance + LEAST_SURE * (1 - chance) if len(net.langs) > 1 else 0.0
    fed, restore = set_aside(docs, ("lang_pred", "lang_score", "lang_sure"))
    return restore(predict(fed, net, text_col).where((F.col("lang_sure") > 0) & (F.col("lang_sure") >= least)))
