"""Exact n-gram Jaccard join by prefix trees, with groups of linked documents.

1. Each text's set of word n-grams (64-bit hashes) gets a digest; equal sets become one class, named
   by its smallest document id, and only one text of a class goes on.
2. Only classes that share a key (see 3) with another go on, and only keys travel for that, some bytes each.
   Document frequencies of all n-grams of those classes are counted: n-grams travel packed, by hash range,
   and those of two classes or more travel back to their documents.  The global order is by the
   frequency's bit length, then hash; an n-gram that no other class has takes part in no link.
3. Sets that can link differ in a bounded number of n-grams, so when both are dealt by hash into more parts
   than that, some parts are equal.  Hashes of parts are a set's keys, and classes that share a key are put
   together, through stars, not pairs.  A part holds several n-grams, so single n-grams that texts share by
   chance bring nothing together; a set with too many empty parts also has the n-grams of its prefix as keys.
4. Each such group's ordered sets are stored in a path-compressed trie; a set is joined by walking the
   trie, so sets with a common beginning share their partial overlap, and a subtree is left when even
   all that remains below it, or in the set, cannot reach the overlap that a link needs.  Sets already
   known to be connected are not compared again.  Groups over ``GROUP_MEMBERS`` sets are joined block by
   block, then one set of each block with those of others; what is then not in the largest component is
   joined with the blocks, or, if that is much, with the sets of other components that share a key.
5. Components of the links found are the groups of documents.

Only links between different sets are made, and of those as many as connect them: enough for exact
components without all pairs of a group.  A collision of two 64-bit hashes within a pair of texts is
the only inexactness (below 1e-13 for texts of a thousand words).

Defined cases: null and wordless texts have empty sets and link with nothing; a text of fewer words
than n is one n-gram; repeated rows are copies, and rows that share an id belong together; null ids
link with nothing and have a null component; an empty table gives an empty result; only the id and
text columns are read, and the result is joined by id, so extra columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tessera.llm.common import slices, worker_state
from tessera.llm.graph import checkpointed, connected

#: Words whose hashes a worker remembers, and their greatest length (longer ones are hashed anew); members
#: of a group that one trie task takes; copies whose ids are broadcast at most (more are joined by shuffle).
MEMO_WORDS, MEMO_LENGTH, GROUP_MEMBERS, BROADCAST_COPIES = 300_000, 64, 500, 2_000_000
#: N-grams that a block of documents holds (more when there are very many hash ranges), that a hash range
#: holds on average, and that one task reads.
BLOCK_GRAMS, RANGE_GRAMS, TASK_GRAMS = 1_000_000, 4_000_000, 8_000_000
#: Parts in which a group's number of blocks goes to its members.
SALTS = 16
#: Bits that a passed id has in the marks of ids that are too many to broadcast.
MARK_BITS = 16
#: Outsiders of a group, in units of ``GROUP_MEMBERS``, up to which they are joined with its blocks.
OUTSIDE_CHUNKS = 32
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOW = np.uint64(0xFFFFFFFF)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_LENGTH:
            self[word] = value
        return value


def grams_of(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """The sorted set of n-gram hashes; ASCII letters lower-cased, words split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(width, len(h))
    out = h[: len(h) - n + 1] * _A
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * _B + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(29)
    out = (out + np.uint64(n)) * _C
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _keys(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, digest) of every document, without its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("jaccard", _WordHashes)
        for whole in batches:
            for batch in slices(whole, 1):
                sets = [grams_of(t, width, hashes) for t in batch.column(1).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary())], names=["id", "n", "digest"])

    return docs.mapInArrow(run, "id long, n long, digest binary")


_PACKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary())])


def _pack_steps(index: np.ndarray) -> bytes:
    """Rising numbers as bytes of their differences; 255 goes on."""
    step = np.diff(index, prepend=0)
    ends = np.cumsum(step // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = step % 255
    return out.tobytes()


def _unpack_steps(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _blocks(batches: Iterator[pa.RecordBatch], width: int, most: int, rows: Callable[[int, list[int], list[np.ndarray]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``rows`` makes of blocks of documents: block number, ids and n-gram sets, about ``most`` n-grams in all."""
    hashes = worker_state("jaccard", _WordHashes)
    block, ids, sets, held = TaskContext.get().partitionId() << 20, [], [], 0
    for whole in batches:
        for batch in slices(whole, 1):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = grams_of(text, width, hashes)
                if len(s):
                    ids.append(i)
                    sets.append(s)
                    held += len(s)
                if held >= most:
                    yield from rows(block, ids, sets)
                    block, ids, sets, held = block + 1, [], [], 0
    if ids:
        yield from rows(block, ids, sets)


def _packed(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """N-grams of blocks of documents by hash range; one more row a block has its ids and set sizes."""

    def rows(block: int, ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.int64)
        grams = np.concatenate(sets)
        part = (grams >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(part, kind="stable")  # within a part by document
        part, low = part[order], grams[order].view(np.uint8).reshape(-1, 8)[:, :7]
        doc = np.repeat(np.arange(len(sets)), sizes)[order]
        present, starts = np.unique(part, return_index=True)
        out: dict[str, list] = {k: [] for k in _PACKED.names}
        for p, a, b in zip(present.tolist(), starts, [*starts[1:], len(part)], strict=True):
            for k, x in zip(_PACKED.names, (p, block, low[a:b].tobytes(), _pack_steps(doc[a:b]), None), strict=True):
                out[k].append(x)
        for k, x in zip(_PACKED.names, (block % (1 << bits), block, None, np.array(ids, np.int64).tobytes(), sizes.tobytes()), strict=True):
            out[k].append(x)
        yield pa.RecordBatch.from_pydict(out, schema=_PACKED)

    return docs.mapInArrow(lambda batches: _blocks(batches, width, BLOCK_GRAMS << min(max(bits - 14, 0), 3), rows), "part int, block long, grams binary, docs binary, sizes binary")


def _shared(packed: DataFrame, bits: int, tasks: int) -> DataFrame:
    """Of each block the n-grams that two documents or more have, with the bit lengths of their frequencies."""

    def run(table: pa.Table) -> pa.Table:
        heads, bodies = [], []
        for row in table.to_pylist():
            (heads if row["grams"] is None else bodies).append(row)
        out: dict[str, list] = {k: [] for k in _PACKED.names}
        for row in heads:
            for k in out:
                out[k].append(row[k])
        if bodies:
            counts = [len(r["grams"]) // 7 for r in bodies]
            low = np.zeros((sum(counts), 8), np.uint8)
            low[:, :7] = np.frombuffer(b"".join(r["grams"] for r in bodies), np.uint8).reshape(-1, 7)
            low[:, 7] = bodies[0]["part"] >> (bits - 8)
            grams = low.reshape(-1).view(np.uint64)
            doc = np.concatenate([_unpack_steps(r["docs"]) for r in bodies])
            order = np.argsort(grams, kind="stable")
            ordered = grams[order]
            first = np.nonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))[0]
            runs = np.diff(first, append=len(ordered))
            level = np.empty(len(grams), np.uint8)
            level[order] = np.repeat(np.frexp(runs.astype(np.float64))[1].astype(np.uint8), runs)
            ends = np.cumsum(counts)
            for row, a, b in zip(bodies, ends - counts, ends, strict=True):
                many = level[a:b] > 1
                if many.any():
                    for k, x in zip(_PACKED.names, (row["part"], row["block"], low[a:b, :7][many].tobytes(), _pack_steps(doc[a:b][many]), level[a:b][many].tobytes()), strict=True):
                        out[k].append(x)
        return pa.Table.from_pydict(out, schema=_PACKED)

    return packed.repartition(tasks, "part").groupBy("part").applyInArrow(run, "part int, block long, grams binary, docs binary, sizes binary")


@lru_cache(16)
def _bands(percent: int) -> np.ndarray:
    """Bounds of size bands: sets that link are of one band or of two neighbours."""
    out, ratio = [1], min(percent, 95)
    while out[-1] < 1 << 40:
        out.append(-(-out[-1] * 100 // ratio))
    return np.array(out, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def keys_of(gram: np.ndarray, doc: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key) of sets' n-grams by doc, and which docs have too many empty parts.

    Two sets that link have at least ``percent`` of their union in common, so of n-grams that one of them
    alone has there are at most ``most`` for their band.  Dealt into ``most + spare + 1`` parts, more than
    ``spare`` parts are equal.  A set with ``spare`` empty parts at most has one of those that is not empty.
    N-grams that no other set has may be left out of the sets: they only add to what differs.
    """
    bounds = _bands(percent)
    band = np.searchsorted(bounds, sizes, side="right") - 1
    docs, keys, poor = [], [], np.zeros(len(sizes), bool)
    for turn in (band, band + 1):  # with the sets of the band below, and of the band above
        most = 2 * (bounds[turn + 1] - 1) * (100 - percent) // (100 + percent)
        spare = 2 + most // 10
        parts = most + spare + 1
        salt = _mixed(turn.astype(np.uint64) + _A)
        begin = np.concatenate([[0], np.cumsum(parts)])
        slot = begin[doc] + (_mixed(gram ^ salt[doc]) % parts[doc].astype(np.uint64)).astype(np.int64)
        held = np.flatnonzero(np.bincount(slot, minlength=begin[-1]))
        mixed = _mixed(gram * _A)  # summed as halves, which doubles hold exactly
        low, high = (np.bincount(slot, weights=half.astype(np.float64), minlength=begin[-1])[held].astype(np.uint64) for half in (mixed & _LOW, mixed >> np.uint64(32)))
        content = low + (high << np.uint64(32))
        owner = np.repeat(np.arange(len(sizes)), parts)[held]
        docs.append(owner)
        keys.append(_mixed(content + salt[owner] * (held - begin[owner] + 1).astype(np.uint64)))
        poor |= parts - np.bincount(owner, minlength=len(sizes)) > spare
    return np.concatenate(docs), np.concatenate(keys), poor


_KEYED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])


def _likely(docs: DataFrame, width: int, percent: int, bits: int, tasks: int) -> DataFrame:
    """Ids of the documents that share a key with another; all that link with any are among them.

    Keys are those of whole sets, a fraction of the n-grams, and ``bits`` + 40 bits of each are sent: by
    chance equal ones only let a document pass.  Any order serves for the prefix of a set, here that of hashes.
    """

    def rows(block: int, ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.int64)
        doc, key, poor = keys_of(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes, percent)
        prefixes = {k: sets[k][: sizes[k] + percent * -sizes[k] // 100 + 1] for k in np.flatnonzero(poor).tolist()}
        doc = np.concatenate([doc, *(np.full(len(x), k) for k, x in prefixes.items())])
        key = np.concatenate([key, *(_mixed(x) for x in prefixes.values())])
        part = (key >> np.uint64(64 - bits)).astype(np.int32)
        order = np.lexsort((doc, part))
        part, doc = part[order], doc[order]
        low = (key[order] >> np.uint64(24 - bits)).view(np.uint8).reshape(-1, 8)[:, :5]
        present, starts = np.unique(part, return_index=True)
        out: dict[str, list] = {k: [] for k in _KEYED.names}
        for p, a, b in zip(present.tolist(), starts, [*starts[1:], len(part)], strict=True):
            for k, x in zip(_KEYED.names, (p, block, low[a:b].tobytes(), _pack_steps(doc[a:b])), strict=True):
                out[k].append(x)
        for k, x in zip(_KEYED.names, (block % (1 << bits), block, None, np.array(ids, np.int64).tobytes()), strict=True):
            out[k].append(x)
        yield pa.RecordBatch.from_pydict(out, schema=_KEYED)

    def shared(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in _KEYED.names}
        bodies = []
        for row in table.to_pylist():
            if row["keys"] is not None:
                bodies.append(row)
                continue
            for k in out:
                out[k].append(row[k])
        if bodies:
            counts = [len(r["keys"]) // 5 for r in bodies]
            low = np.zeros((sum(counts), 8), np.uint8)
            low[:, :5] = np.frombuffer(b"".join(r["keys"] for r in bodies), np.uint8).reshape(-1, 5)
            _, at, many = np.unique(low.reshape(-1).view(np.uint64), return_inverse=True, return_counts=True)
            met = many[at] > 1
            ends = np.cumsum(counts)
            for row, a, b in zip(bodies, ends - counts, ends, strict=True):
                if met[a:b].any():
                    for k, x in zip(_KEYED.names, (row["part"], row["block"], b"", _pack_steps(np.unique(_unpack_steps(row["docs"])[met[a:b]]))), strict=True):
                        out[k].append(x)
        return pa.Table.from_pydict(out, schema=_KEYED)

    def named(table: pa.Table) -> pa.Table:
        ids, met = np.zeros(0, np.int64), [np.zeros(0, np.int64)]
        for row in table.to_pylist():
            if row["keys"] is None:
                ids = np.frombuffer(row["docs"], np.int64)
            else:
                met.append(_unpack_steps(row["docs"]))
        return pa.table({"id": pa.array(ids[np.unique(np.concatenate(met))], pa.int64())})

    kind = "part int, block long, keys binary, docs binary"
    keyed = docs.mapInArrow(lambda batches: _blocks(batches, width, BLOCK_GRAMS // 2 << min(max(bits - 12, 0), 3), rows), kind)
    met = keyed.repartition(tasks, "part").groupBy("part").applyInArrow(shared, kind)
    return met.repartition(tasks, "block").groupBy("block").applyInArrow(named, "id long").distinct()


_CANDIDATES = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("grams", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _candidates(shared: DataFrame, percent: int, bits: int, tasks: int) -> DataFrame:
    """Documents whose shared n-grams suffice for a link, in global order, with their keys."""

    def run(table: pa.Table) -> pa.Table:
        ids = sizes = None
        grams, docs, levels = [], [], []
        for row in table.to_pylist():
            if row["grams"] is None:
                ids, sizes = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["sizes"], np.int64)
            else:
                whole = np.full((len(row["grams"]) // 7, 8), row["part"] >> (bits - 8), np.uint8)
                whole[:, :7] = np.frombuffer(row["grams"], np.uint8).reshape(-1, 7)
                grams.append(whole.reshape(-1).view(np.uint64))
                docs.append(_unpack_steps(row["docs"]))
                levels.append(np.frombuffer(row["sizes"], np.uint8))
        out: dict[str, list] = {k: [] for k in _CANDIDATES.names}
        need = -(-percent * sizes // 100)
        doc = np.concatenate(docs) if grams else np.zeros(0, np.int64)
        held = (np.bincount(doc, minlength=len(ids)) >= need)[doc]
        if held.any():
            gram, doc, level = np.concatenate(grams)[held], doc[held], np.concatenate(levels)[held]
            order = np.lexsort((gram, level, doc))
            gram, doc = gram[order], doc[order]
            starts = np.searchsorted(doc, np.arange(len(ids) + 1))
            who, number = np.unique(doc, return_inverse=True)
            owner, keys, poor = keys_of(gram, number, sizes[who], percent)
            keys = keys[np.argsort(owner, kind="stable")].view(np.int64)
            ends = np.cumsum(np.bincount(owner, minlength=len(who)))
            for k, a, b, short in zip(who.tolist(), [0, *ends[:-1]], ends, poor, strict=True):
                own = gram[starts[k] : starts[k + 1]]
                prefix = own[: len(own) - need[k] + 1] if short else own[:0]  # those before it are in no other set
                for c, x in zip(_CANDIDATES.names, (ids[k], sizes[k], own.tobytes(), np.concatenate([keys[a:b], prefix.view(np.int64)])), strict=True):
                    out[c].append(x)
        return pa.Table.from_pydict(out, schema=_CANDIDATES)

    return shared.repartition(tasks, "block").groupBy("block").applyInArrow(run, "id long, n long, grams binary, keys array<long>")


class _Node:
    """Of a path-compressed trie: its n-grams, children by first n-gram, sets that end here; below it,
    the smallest set size and the most n-grams left."""

    __slots__ = ("grams", "children", "ends", "least", "left")

    def __init__(self, grams: list[int]) -> None:
        self.grams, self.children, self.ends = grams, {}, []
        self.least, self.left = 1 << 60, 0


class Trie:
    """Ordered sets; ``percent`` of the union must be shared for a link."""

    def __init__(self, percent: int) -> None:
        self.percent, self.root = percent, _Node([])

    def insert(self, grams: list[int], size: int, who: int) -> None:
        node, at = self.root, 0
        node.least, node.left = min(node.least, size), max(node.left, len(grams))
        while at < len(grams):
            child = node.children.get(grams[at])
            if child is None:
                child = _Node(grams[at:])
                child.least = size
                node.children[grams[at]] = child
                node, at = child, len(grams)
                break
            own, k = child.grams, 1
            while k < len(own) and at + k < len(grams) and own[k] == grams[at + k]:
                k += 1
            if k < len(own):  # the sets part inside the node
                upper = _Node(own[:k])
                upper.least, upper.left = child.least, child.left + len(own) - k
                upper.children[own[k]] = child
                child.grams = own[k:]
                node.children[grams[at]] = child = upper
            at += k
            child.least, child.left = min(child.least, size), max(child.left, len(grams) - at)
            node = child
        node.ends.append((who, size))

    def linked(self, place: dict[int, int], size: int) -> Iterator[int]:
        """Who links with the set whose n-grams have these places in its order."""
        total, percent = len(place), self.percent
        stack = [(self.root, 0, 0)]  # node, overlap above it, first place not yet passed
        while stack:
            node, overlap, passed = stack.pop()
            need = -(-percent * (node.least + size) // (100 + percent))
            grams, n = node.grams, len(node.grams)
            cut = False
            for a in range(0, n, 16):
                for g in grams[a : a + 16]:
                    p = place.get(g)
                    if p is not None:
                        overlap, passed = overlap + 1, p + 1
                if overlap + min(max(n - a - 16, 0) + node.left, total - passed) < need:
                    cut = True
                    break
            if cut:
                continue
            for who, other in node.ends:
                if overlap * (100 + percent) >= percent * (other + size):
                    yield who
            stack += [(child, overlap, passed) for child in node.children.values()]


def components_of(n: int, links: list[tuple[int, int]]) -> list[int]:
    """Each node's component, by its smallest node."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def join_group(sets: list[tuple[list[int], int]], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets (n-grams in order, size) of a group; ``known``: their components.

    Leaders first: a set is joined with the trie of leaders and becomes one itself if it links with
    none.  Then only a set that follows a leader can have links unseen, to sets of other components:
    the followers of each component, in a trie, are joined with the sets of all others.
    """
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []

    def link(a: int, b: int) -> None:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))

    led: set[int] = set()  # components that have a leader, of those known before
    if known is not None:
        first: dict[int, int] = {}
        for i, c in enumerate(known):
            parent[i] = first.setdefault(c, i)
    leaders, followers = Trie(percent), []
    places = [{g: i for i, g in enumerate(grams)} for grams, _ in sets] if len(sets) < 4 * GROUP_MEMBERS else None
    place = (lambda i: places[i]) if places else (lambda i: {g: k for k, g in enumerate(sets[i][0])})
    for i, (grams, size) in enumerate(sets):
        found = known is not None and known[i] in led
        if not found:
            for other in leaders.linked(place(i), size):
                link(i, other)
                found = True
        if found:
            followers.append(i)
        else:
            leaders.insert(grams, size, i)
            if known is not None:
                led.add(known[i])
    by_root: dict[int, list[int]] = {}
    for i in followers:
        by_root.setdefault(root(i), []).append(i)
    if len({root(i) for i in range(len(sets))}) > 1:
        for members in by_root.values():
            trie = Trie(percent)
            for i in members:
                trie.insert(*sets[i], i)
            for i in range(len(sets)):
                if root(i) != root(members[0]):
                    for other in trie.linked(place(i), sets[i][1]):
                        link(i, other)
                        break  # the whole trie is one component
    return out


def _links(candidates: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between candidate documents, from tries over groups that share keys."""
    each = candidates.select("id", F.explode("keys").alias("key"))
    star = each.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("many")).where("many > 1").select("key", "least")
    near = each.join(star, "key").where(F.col("id") != F.col("least")).select(F.col("id").alias("a"), F.col("least").alias("b"))
    group = checkpointed(connected(near).select(F.col("node").alias("id"), F.col("component").alias("grp")))
    # Only large groups have a number of blocks, which goes to their members in salted parts.
    blocks = group.groupBy("grp").agg(F.ceil(F.count("*") / GROUP_MEMBERS).cast("int").alias("blocks")).where("blocks > 1")
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sized = group.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(blocks, ["grp", "salt"], "left").select("id", "grp", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    placed = candidates.select("id", "n", "grams").join(sized, "id").withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    links = _joined(_cells(placed.where("blocks = 1"), F.lit(0), F.lit(0)), percent)
    large = checkpointed(placed.where("blocks > 1"))
    return links if large.isEmpty() else links.unionByName(_large_group_links(large, each, percent))


def _cells(df: DataFrame, i: Column, j: Column, known: Column | None = None) -> DataFrame:
    return df.select("id", "n", "grams", "grp", i.cast("int").alias("i"), j.cast("int").alias("j"), (F.lit(None).cast("long") if known is None else known).alias("known"))


def _joined(dealt: DataFrame, percent: int) -> DataFrame:
    """Links within every cell (grp, i, j) of sets, of which known components need none.

    Of each cell also a link of one set with itself: the smallest id of the largest component.  Cells are
    dealt out one by one, whatever the partitioning before, so that no group is one task.
    """

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable").tolist()
        rows, sizes, known = (table.column(c).to_pylist() for c in ("grams", "n", "known"))
        sets = [(np.frombuffer(rows[k], np.uint64).tolist(), sizes[k]) for k in order]
        found = join_group(sets, percent, None if known[0] is None else [known[k] for k in order])
        roots = components_of(len(sets), found)
        sizes = Counter(roots)
        found.append((stands := max(sizes, key=lambda k: (sizes[k], -k)), stands))
        return pa.table({"a": pa.array([int(ids[order[a]]) for a, _ in found], pa.int64()), "b": pa.array([int(ids[order[b]]) for _, b in found], pa.int64())})

    return dealt.repartition("grp", "i", "j").groupBy("grp", "i", "j").applyInArrow(run, "a long, b long")


def _large_group_links(placed: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """Links of groups of several blocks, without all pairs of blocks.

    Each block is joined by itself; one set of each block's largest component stands for it among the
    blocks.  Most of such a group (copies of one text with small changes) is then one component, and
    sets within a component need no comparison.  What is not in a group's largest component, the
    outsiders, is joined with every block if it is little: two sets of different components have an
    outsider.  Where there are many outsiders (texts of one frame, alike but not enough), only sets of
    different components that share a key are joined: each set goes to as many cells as it has such keys,
    however large the group is.
    """

    within = checkpointed(_joined(_cells(placed, F.col("own"), F.col("own")), percent))
    among = placed.join(within.where("a = b").select(F.col("a").alias("id")), "id", "left_semi")
    between = checkpointed(_joined(_cells(among, F.pmod(F.xxhash64("id"), F.ceil(F.col("blocks") / GROUP_MEMBERS)), F.lit(-1)), percent))
    found = connected(within.unionByName(between)).select(F.col("node").alias("id"), "component")
    known = checkpointed(placed.select("id", "grp", "own").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    largest = known.groupBy("grp", "component").agg(F.count("*").alias("size")).groupBy("grp").agg(F.max_by("component", F.struct("size", (-F.col("component")).alias("c"))).alias("largest"))
    outside = known.join(largest, "grp").where(F.col("component") != F.col("largest")).select("id", "grp")
    chunks = checkpointed(outside.groupBy("grp").agg(F.ceil(F.count("*") / GROUP_MEMBERS).cast("int").alias("chunks")))
    links = within.unionByName(between)
    few = chunks.where(F.col("chunks") <= OUTSIDE_CHUNKS)
    if not few.isEmpty():
        outsiders = placed.join(outside.select("id"), "id", "left_semi").join(few, "grp")
        to_all = outsiders.withColumns({"j": F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")), "i": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
        at_home = placed.join(few, "grp").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        both = _cells(to_all.where(F.col("i") != F.col("own")), F.col("i"), F.col("j")).unionByName(_cells(at_home, F.col("own"), F.col("j")))
        links = links.unionByName(_joined(both, percent))
    many = chunks.where(F.col("chunks") > OUTSIDE_CHUNKS)
    if not many.isEmpty():
        member = keys.join(known.join(many, "grp", "left_semi").select("id", "component"), "id")
        mixed = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / GROUP_MEMBERS).cast("int").alias("blocks")).where("low < high").select("key", "blocks")
        at = member.join(mixed, "key").distinct().withColumn("own", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = placed.select("id", "n", "grams").join(at.select("id", F.col("key").alias("grp"), "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), "id")
        links = links.unionByName(_joined(_cells(dealt, F.col("i"), F.col("j"), F.col("component")), percent))
    return links


def _marked(rows: DataFrame, key: Column, ids: DataFrame, salt: int) -> DataFrame:
    """Rows whose key has the same mark as one of ids: all of theirs, and one in ``MARK_BITS`` of the others.

    Marks are bits of 4 KB pieces, two bytes an id in all, so they are broadcast where ids are too many.
    """
    pieces = -(-ids.count() * MARK_BITS // 32768)
    mark = lambda x: F.pmod(F.xxhash64(x, F.lit(salt)), F.lit(pieces * 32768))
    own = ids.select(mark(F.col("__id")).alias("__mark")).select(F.floor(F.col("__mark") / 32768).alias("__piece"), F.pmod("__mark", F.lit(32768)).alias("__mark"))
    bits = own.repartition("__piece").groupBy("__piece").agg(F.bitmap_construct_agg("__mark").alias("__bits"))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(F.pmod(mark(key), F.lit(32768)) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(mark(key), F.lit(8)))), F.lit(2)) == 1
    return rows.join(F.broadcast(bits), F.floor(mark(key) / 32768) == F.col("__piece")).where(held).drop("__piece", "__bits")


def _rows_of(rows: DataFrame, key: Column, ids: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose key is one of ids, of which and of ``others`` (both __id) all keys are that are not null.

    Rows stay where they are, however many ids there are: what is not marked goes, until those of the
    others that are marked by chance are few enough to broadcast.
    """
    salt = 0
    while True:
        if ids.count() <= BROADCAST_COPIES:
            return rows.join(F.broadcast(ids), key == F.col("__id"), "left_semi")
        if others.count() <= BROADCAST_COPIES:
            return rows.where(key.isNotNull()).join(F.broadcast(others), key == F.col("__id"), "left_anti")
        rows, others, salt = _marked(rows, key, ids, salt), checkpointed(_marked(others, F.col("__id"), ids, salt)), salt + 1


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every row: its set's size, the smallest id linked to it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = checkpointed(_keys(rows, width))
    classes = keys.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"))
    # Two salts give this join exchanges of its own, so AQE can split a text with very many copies.
    salted = classes.withColumn("salt", F.explode(F.array(F.lit(0), F.lit(1))))
    named = checkpointed(keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")).join(salted, ["digest", "salt"], "left").drop("salt"))
    firsts = named.where("id = first").select("id").distinct()
    copies = named.where("first is null or id <> first").select("id").distinct().join(firsts, "id", "left_anti").where("id is not null")

    texts, as_id = rows.where("id is not null"), lambda ids: ids.select(F.col("id").alias("__id"))
    # Hash ranges and tasks grow with the n-grams of the texts that go on.
    total = named.where("id = first").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(8, (total // RANGE_GRAMS).bit_length())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), total // TASK_GRAMS)
    likely = checkpointed(_likely(_rows_of(texts, F.col("id"), as_id(firsts), as_id(copies)), width, percent, bits, tasks))
    unlike = named.select("id").where("id is not null").distinct().join(likely, "id", "left_anti")
    candidates = checkpointed(_candidates(_shared(_packed(_rows_of(texts, F.col("id"), as_id(likely), as_id(unlike)), width, bits), bits, tasks), percent, bits, tasks))
    links = _links(candidates, percent)
    # An id with several texts is one node; its texts' classes hang together through it.
    same = named.where("first is not null and id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).join(firsts.select(F.col("id").alias("a")), "a", "left_semi")
    found = connected(links.unionByName(same)).select(F.col("node").alias("first"), "component")
    out = named.join(found, "first", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "first", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the smallest id's.

    Only rows whose id is repeated are shuffled (one of them stays); rows of null id all stay.
    """
    found = near_groups(docs, id_col, text_col, width=width, percent=percent).select(F.col(id_col).alias("__id"), "component_id").where("__id is not null")
    by_id = checkpointed(found.groupBy("__id").agg(F.min("component_id").alias("component"), F.count("*").alias("rows")).where("component <> __id or rows > 1"))
    gone, twice = by_id.where("component <> __id").select("__id"), by_id.where("component = __id").select("__id")
    key = docs[id_col].cast("long")
    if gone.count() <= BROADCAST_COPIES and twice.count() <= BROADCAST_COPIES:
        kept = docs.join(F.broadcast(gone), key == F.col("__id"), "left_anti")
        repeated, rest = (kept.join(F.broadcast(twice), key == F.col("__id"), how) for how in ("left_semi", "left_anti"))
    else:
        ids = checkpointed(found.select("__id").distinct())
        once = checkpointed(ids.join(by_id.select("__id"), "__id", "left_anti"))
        repeated = _rows_of(docs, key, twice, once.unionByName(gone))
        rest = _rows_of(docs, key, once, by_id.select("__id")).unionByName(docs.where(key.isNull()))
    row = F.row_number().over(W.Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last(), *(F.col(c) for c in docs.columns if c not in (id_col, text_col) and not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType)))))
    one = repeated.withColumn("__row", row).where("__row = 1").select(*docs.columns)
    return rest.unionByName(one)


#: DuckDB SQL of the query's groups (four words, 85 of 100), by joining shingles.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 100 * i >= 85 * (m.n + k.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM documents d JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) ON a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
