"""Byte-level BPE encoding and decoding.

Two tiers.  A minimal perfect hash over the vocabulary resolves every pre-token that is itself a
vocabulary entry with one probe and one comparison; every other pre-token is merged with a heap of
(rank, position) over a linked list of its bytes, O(n log n) in its length.

Defined cases: a null text is the empty text (0 tokens, digest of the empty string); texts of any
length are encoded whole; the result of a row depends on its text alone, so ties and repeated rows
give equal results; an empty table gives an empty result; no column of the input other than the id
and text columns named by the caller is read, so extra columns may have any name.
"""

from __future__ import annotations

import base64
import gc
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, worker_state

#: Resolved pre-tokens of one memo generation, and their length in all.  A worker holds two: what is used
#: again moves to the young one, and when that is full the old one goes, so memory is bounded and frequent
#: words stay.
MEMO_ENTRIES, MEMO_LENGTH = 270_000, 4 << 20
#: Bytes of text that are split and looked up together.
SLICE_BYTES = 1 << 20
#: Mean keys per bucket of the perfect hash.
BUCKET_KEYS = 4
#: A resolved pre-token: its ids as decimal text joined by one space.
Piece = str
#: Patterns with a form for the standard engine.  The forms agree on every text whose characters are of
#: one class (letter, number, white space, other) to that engine and to the library that is followed.
FASTER = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+",
}
#: For each class its pattern, that of the standard engine, and a character on which no pattern depends.
_CLASSES = ((r"\p{L}", r"[^\W\d_]", "\u0416"), (r"\p{N}", r"\d", "1"), (r"\s", r"\s", "\t"))
_OTHER = "!"


@lru_cache(1)
def stand_ins() -> dict[int, str]:
    """The characters that the standard engine classes otherwise, by a plain one of their true class.

    The two engines know different versions of Unicode, and hold other things for numerals and white
    space, so all code points are asked for; the truth is what the library itself matches.
    """
    import tiktoken  # on the driver only: workers get the result

    every = "".join(map(chr, (x for x in range(0x110000) if not 0xD800 <= x < 0xE000)))
    single = {bytes((i,)): i for i in range(256)}
    out: dict[int, str] = {}
    for pattern, ours, plain in _CLASSES:
        matched = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        truth, found = set(bytes(matched).decode()), set(re.findall(ours, every))
        out |= {ord(x): plain for x in truth - found}
        for x in found - truth:
            out.setdefault(ord(x), _OTHER)
    return out


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def read_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """Vocabulary entries by rank from a rank file (base64 entry, space, rank per line).

    A path with a scheme is read by Spark; a plain path is a file of the driver (the vocabulary is
    installed with the library, not data).  The vocabulary is a fixed-size model, not corpus data.
    """
    if "://" in path:
        lines = [r[0].encode() for r in spark.read.text(path).collect()]
    else:
        with open(path, "rb") as f:
            lines = f.read().split(b"\n")
    pairs = [(int(b), base64.b64decode(a)) for a, b in (x.split() for x in lines if x.strip())]
    vocab = [b""] * (max(r for r, _ in pairs) + 1)
    for rank, entry in pairs:
        vocab[rank] = entry
    return vocab


def _hashes(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, all keys of a length at once."""
    out = np.empty(len(keys), np.uint64)
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    for n in np.unique(lengths):
        at = np.nonzero(lengths == n)[0]
        h = np.full(len(at), (int(n) * int(_M2) + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        if n:
            columns = np.frombuffer(b"".join([keys[i] for i in at]), np.uint8).reshape(len(at), n)
            for j in range(n):
                h = (h ^ columns[:, j]) * _M1
                h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(32))) * _M3
        out[at] = h ^ (h >> np.uint64(29))
    return out


def _slots(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (seed.astype(np.uint64) * _M2)) * _M1
    x ^= x >> np.uint64(31)
    x *= _M3
    return ((x >> np.uint64(11)) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash by hash and displace: n keys, n slots, one seed a bucket of keys."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // BUCKET_KEYS)
        h = _hashes(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("two keys have one hash")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.seeds = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(self.n, -1, np.int64)
        taken = np.zeros(self.n, bool)
        sizes = np.diff(starts)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            own = order[starts[b] : starts[b + 1]]
            first, step = 0, 64
            while True:  # seeds are tried in blocks; any free arrangement ends the search
                seeds = np.arange(first, first + step)
                s = _slots(h[own][None, :], seeds[:, None], self.n)
                free = ~taken[s].any(axis=1)
                if len(own) > 1:
                    t = np.sort(s, axis=1)
                    free &= (t[:, 1:] != t[:, :-1]).all(axis=1)
                if free.any():
                    at = int(np.argmax(free))
                    self.seeds[b] = seeds[at]
                    self.key_at[s[at]] = own
                    taken[s[at]] = True
                    break
                first, step = first + step, min(step * 4, 65536)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key the one number of a stored key that it can be; the caller compares."""
        h = _hashes(keys)
        return self.key_at[_slots(h, self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)], self.n)]


class Memo:
    """Resolved pre-tokens of a worker, in two generations."""

    def __init__(self) -> None:
        self.young: dict[str, Piece] = {}
        self.old: dict[str, Piece] = {}
        self.length = 0


class Codec:
    """Encoder and decoder of one vocabulary; built once on the driver and sent to the workers."""

    def __init__(self, vocab: list[bytes], pattern: str) -> None:
        self.vocab, self.pattern = vocab, pattern
        self.ids = [i for i, x in enumerate(vocab) if x]
        self.hash = PerfectHash([vocab[i] for i in self.ids])
        self.longest = max(map(len, vocab))
        self.stand_ins = stand_ins() if pattern in FASTER else {}

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("vocab", "pattern", "ids", "hash", "longest", "stand_ins")}

    def ready(self) -> "Codec":
        """Makes what is derived and not sent: the compiled pattern, ranks by bytes, the memo."""
        if not hasattr(self, "split"):
            self.split = re.compile(FASTER[self.pattern]).findall if self.pattern in FASTER else regex.compile(self.pattern).findall
            self.apart = frozenset(map(chr, self.stand_ins))
            self.named = {str(i): x for i, x in enumerate(self.vocab)}
            self.rank = {x: i for i, x in enumerate(self.vocab) if x}
            self.first = [self.rank.get(bytes((a, b))) for a in range(256) for b in range(256)]
            self.memo = Memo()
        return self

    def split_exactly(self, text: str) -> list[str]:
        """The pre-tokens of a text with characters that the engine classes otherwise."""
        ends = list(accumulate(map(len, self.split(text.translate(self.stand_ins)))))
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Tier two: the lowest-ranked adjacent pair merges first, the leftmost of equals.

        ``end[i]`` links the part that starts at byte i to the next one (0: it has merged into
        its left neighbour), ``start[e]`` links back; a heap entry names the bytes it would join.
        """
        rank, n = self.rank, len(piece)
        get, pop, push = rank.get, heapq.heappop, heapq.heappush
        first = self.first
        heap = [(r, i, i + 2) for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False)) if (r := first[a << 8 | b]) is not None]
        heapq.heapify(heap)
        end, start = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            _, i, e = pop(heap)
            m = end[i]
            if not m or m >= e or end[m] != e:
                continue  # one of its two parts has merged since
            end[i], end[m], start[e] = e, 0, i
            if e < n and (r := get(piece[i : end[e]])) is not None:
                push(heap, (r, i, end[e]))
            if i and (r := get(piece[start[i] : e])) is not None:
                push(heap, (r, start[i], e))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def resolve(self, pieces: list[str]) -> dict[str, Piece]:
        """Ids of distinct pre-tokens as decimal text."""
        raw = [x.encode() for x in pieces]
        short = [i for i, x in enumerate(raw) if len(x) <= self.longest]
        whole = np.full(len(raw), -1, np.int64)
        if short:
            whole[short] = self.hash.find([raw[i] for i in short])
        out = {}
        for piece, key, at in zip(pieces, raw, whole.tolist(), strict=True):
            if at >= 0 and self.vocab[self.ids[at]] == key:
                ids: tuple[int, ...] = (self.ids[at],)
            else:
                ids = self.merge(key)
            out[piece] = " ".join(map(str, ids))
        return out

    def remember(self, pieces: set[str]) -> dict[str, Piece]:
        """These pre-tokens, from the memo, resolving those that neither generation knows."""
        memo = self.memo
        new = pieces.difference(memo.young)
        added = sum(map(len, new))
        if len(memo.young) + len(new) > MEMO_ENTRIES or memo.length + added > MEMO_LENGTH:
            memo.old, memo.young, memo.length = memo.young, {}, 0
            new, added = pieces, sum(map(len, pieces))
        memo.length += added
        old = memo.old
        memo.young.update([(x, old[x]) for x in new if x in old])
        if new := list(new.difference(memo.young)):
            memo.young.update(self.resolve(new))
        return dict(zip(pieces, map(memo.young.__getitem__, pieces), strict=True))

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[Piece]]:
        """For each text its resolved pre-tokens; texts are held together, so words are looked up once.

        The memo holds no pre-token with a character that the engine classes otherwise.  Such a
        character therefore shows among the new pre-tokens, and its texts are split again exactly.
        """
        self.ready()
        split = [self.split(t) if t else [] for t in texts]
        every = set().union(*split)
        special: dict[int, dict] = {}
        if odd := {x for x in every.difference(self.memo.young) if not self.apart.isdisjoint(x)}:
            for i, text in enumerate(texts):
                if not odd.isdisjoint(split[i]):
                    split[i] = self.split_exactly(text)
                    special[i] = self.resolve(list(set(split[i])))
            every = set().union(*(x for i, x in enumerate(split) if i not in special))
        known = self.remember(every)
        for i, pieces in enumerate(split):
            yield list(map((special.get(i) or known).__getitem__, pieces))

    @staticmethod
    def ids_of(found: list[Piece]) -> Iterator[int]:
        return map(int, " ".join(found).split())

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def decode_said(self, said: str) -> bytes:
        """The bytes of ids given as decimal text."""
        return b"".join(map(self.named.__getitem__, said.split()))


def broadcast_codec(spark: SparkSession, path: str, pattern: str):
    """The codec as a broadcast; its size is that of the vocabulary file, whatever the corpus."""
    vocab = read_ranks(spark, path)
    key = sha256(pattern.encode() + b"\0".join(vocab)).hexdigest()
    return spark.sparkContext.broadcast((key, Codec(vocab, pattern)))


_OUTPUTS = {"n_tokens": (pa.int64(), "long"), "ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.binary(), "binary"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encodes every text and decodes the ids again.

    Returns the id, ``n_tokens`` and the ``outputs`` asked for: ``ids``, ``decoded`` (bytes of the
    ids) and their digests ``ids_sha256`` (of decimal ids joined by one space), ``decoded_sha256``.
    One pass, no shuffle; memory is one Arrow batch and the memo.
    """
    sent = broadcast_codec(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codec = sent.value
        codec.ready().memo = worker_state(("bpe", key), Memo)
        made = {
            "n_tokens": lambda found, said, raw: said.count(" ") + 1 if said else 0,
            "ids": lambda found, said, raw: np.array(said.split(), np.int32),
            "decoded": lambda found, said, raw: raw,
            "ids_sha256": lambda found, said, raw: sha256(said.encode()).hexdigest(),
            "decoded_sha256": lambda found, said, raw: sha256(raw).hexdigest(),
        }
        columns = ["n_tokens", *outputs]
        decodes = not {"decoded", "decoded_sha256"}.isdisjoint(outputs)
        gc.disable()  # nothing here is cyclic, and passes over the memo's many tuples cost a third more
        try:
            for whole in batches:
                for batch in slices(whole, 1, SLICE_BYTES):
                    texts = batch.column(1).to_pylist()
                    distinct = list(dict.fromkeys(texts))
                    rows = {}
                    for text, found in zip(distinct, codec.encode_batch(distinct), strict=True):
                        said = " ".join(found)
                        raw = codec.decode_said(said) if decodes else b""
                        rows[text] = [made[c](found, said, raw) for c in columns]
                    cols = zip(*map(rows.__getitem__, texts), strict=True) if texts else [[] for _ in columns]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, _OUTPUTS[c][0]) for c, v in zip(columns, cols, strict=True))], names=["key", *columns])
        finally:
            gc.enable()
            codec.memo = Memo()  # what is kept is the worker's

    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"key {kind}", *(f"{k} {_OUTPUTS[k][1]}" for k in ("n_tokens", *outputs))])
    out = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", id_col)
