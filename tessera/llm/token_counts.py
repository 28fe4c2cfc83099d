"""Exact token counts of texts and of all their prefixes, by dynamic programming over prefixes.

A sequence of tokens is what byte-level BPE makes of its bytes if and only if each two neighbours are,
so the encoding of a prefix is that of a shorter prefix plus the one token that ends here and goes with
its last token.  An automaton over the vocabulary names the tokens that end at each byte, longest first;
each prefix keeps its last token and its count.  Whether two tokens go together is seen from the order of
the merges along their common border.  Pre-tokens are counted on their own and remembered as tables
of counts at every code point; a text's table is made of theirs.  Where a cut makes other pre-tokens than
the whole text has (inside white space, a contraction or a special string) the cut's own are counted.

A stored table answers how many tokens a prefix has (``tokens_of_prefix``) and how far a budget
reaches (``longest_prefix``) without encoding again.  Counts need not rise with the prefix ("ab" may be two
tokens where "abc" is one), so the longest prefix within a budget is the last one that fits, not the first
before one that does not.

Defined cases: a null text is the empty text (no tokens, one empty prefix); texts of any length are counted
whole, one pre-token of any length too; a row's result depends on its text alone, so ties and repeated
rows give equal results, null ids included; an empty table gives an empty result; no column but the id and the
text is read, so extra columns may have any name.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import _CLASSES, _OTHER, FASTER
from tessera.llm.common import slices, worker_state

#: Tables of one memo generation, and their code points in all; a worker holds two generations.
MEMO_ENTRIES, MEMO_LENGTH = 250_000, 6 << 20
#: Pairs of tokens that are remembered.
MEMO_PAIRS = 400_000
#: The pattern that a byte-level pre-tokenizer splits by.
PATTERN = next(iter(FASTER))
#: Contractions that the pattern takes whole, but whose first two characters are two pre-tokens.
PARTED = ("'re", "'ve", "'ll")
_NEVER = 1 << 40
_SHIFT = 24


@lru_cache(1)
def character_classes() -> tuple[dict[int, str], frozenset[str]]:
    """Characters that the standard engine classes otherwise than the library, each by a plain one of its
    true class, and the library's white space.  All code points are asked for."""
    from tokenizers import Regex, pre_tokenizers  # on the driver only: workers get the result

    every = "".join(map(chr, (x for x in range(0x110000) if not 0xD800 <= x < 0xE000)))
    out: dict[int, str] = {}
    truth: set[str] = set()
    for pattern, ours, plain in _CLASSES:
        rest = pre_tokenizers.Split(Regex(pattern + "+"), "removed").pre_tokenize_str(every)
        truth = set(every).difference("".join(x for x, _ in rest))
        found = set(re.findall(ours, every))
        out |= {ord(x): plain for x in truth - found}
        for x in found - truth:
            out.setdefault(ord(x), _OTHER)
    return out, frozenset(truth)  # the last class is white space


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # shown as themselves; the others follow from 256 on
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tables(dict):
    """Counts at every code point of a pre-token, made when first asked for; two generations."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old, self.length = make, {}, 0

    def __missing__(self, piece: str) -> Sequence[int]:
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        self[piece] = found
        self.length += len(piece)
        return found

    def turn(self) -> None:
        """Between texts: starts a new generation if this one is full."""
        if len(self) > MEMO_ENTRIES or self.length > MEMO_LENGTH:
            self.old, self.length = dict(self), 0
            self.clear()


class Together(dict):
    """Whether two tokens go together, by their joint number; remembered up to a bound."""

    def __init__(self, ask) -> None:
        super().__init__()
        self.ask = ask

    def __missing__(self, pair: int) -> bool:
        if len(self) >= MEMO_PAIRS:
            self.clear()
        found = self[pair] = self.ask(pair >> _SHIFT, pair & (1 << _SHIFT) - 1)
        return found


class PrefixCounter:
    """Counts of one vocabulary with ordered merges; built once on the driver and sent to the workers."""

    def __init__(self, spec: dict) -> None:
        kind, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = kind.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        if not plain or spec.get("normalizer") or any(kind.get(k) for k in options) or any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only plain byte-level BPE without a normaliser is counted")
        byte = _alphabet()
        names = {x: bytes(map(byte.__getitem__, x)) for x in kind["vocab"]}
        self.tokens: list[bytes] = [b""] * (max(kind["vocab"].values()) + 1)
        for x, i in kind["vocab"].items():
            self.tokens[i] = names[x]
        self.single = {i for i, x in enumerate(self.tokens) if len(x) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: list[int] = []
        known = set(self.single)
        for merge in kind["merges"]:
            said = merge.split(" ") if isinstance(merge, str) else merge
            a, b = map(kind["vocab"].__getitem__, said)
            whole = kind["vocab"]["".join(said)]
            if whole in known or not {a, b} <= known:
                raise ValueError("a token has two merges, or is merged before its parts")
            self.parts[whole] = (a, b)
            self.merges.append(whole)
            known.add(whole)
        self.special = sorted((x["content"] for x in added if x["content"]), key=len, reverse=True)
        self.stand_ins, self.spaces = character_classes()

    def ready(self) -> "PrefixCounter":
        """Makes what is derived and not sent."""
        if hasattr(self, "automaton"):
            return self
        import ahocorasick

        self.split = re.compile(FASTER[PATTERN]).findall
        # Beyond the first plane any character counts as odd: a class of single ones there is slow to search by.
        self.odd = re.compile("[" + "".join(re.escape(chr(x)) for x in self.stand_ins if x < 0x10000) + "\U00010000-\U0010ffff]").search
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.born = {t: -1 for t in self.single} | {t: k for k, t in enumerate(self.merges)}
        self.pair = {a << _SHIFT | b: self.born[t] for t, (a, b) in self.parts.items()}
        # What stands at a token's right or left end from the single byte to the whole: token and birth of the next.
        right: dict[int, tuple] = {t: (t,) for t in self.single}
        left = dict(right)
        for t in self.merges:
            a, b = self.parts[t]
            left[t], right[t] = (*left[a], t), (*right[b], t)
        after = lambda ends: {t: [(x, self.born[y]) for x, y in zip(x, x[1:], strict=False)] + [(x[-1], _NEVER)] for t, x in ends.items()}
        self.right, self.left = after(right), after(left)
        reached = set(self.single)
        for t in self.merges:
            a, b = self.parts[t]
            if a in reached and b in reached and self.together(a, b, self.born[t]):
                reached.add(t)
        self.size = list(map(len, self.tokens))
        automaton = ahocorasick.Automaton()
        for t in reached:
            automaton.add_word(self.tokens[t].decode("latin-1"), t)
        automaton.make_automaton()
        self.automaton = automaton
        self.tables, self.known = Tables(self.count_piece), Together(self.together)
        return self

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("tokens", "single", "parts", "merges", "special", "stand_ins", "spaces")}

    def together(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether the bytes of two tokens, each its own encoding, are encoded as the two (by the merges born
        ``before`` that one).

        Both grow at the border in the order of their merges; they part for good if no merge over the
        border comes before the next growth.  Of equal merges the leftmost is made first.
        """
        pair, xs, ys = self.pair.get, self.right[a], self.left[b]
        i = j = 0
        while True:
            (x, next_x), (y, next_y) = xs[i], ys[j]
            across = pair(x << _SHIFT | y, _NEVER)
            if across < before and across < next_x and across <= next_y:
                return False
            if next_x <= next_y:
                if next_x == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def count_piece(self, piece: str) -> Sequence[int]:
        """Tokens of the first 1, 2, ... code points of a pre-token."""
        raw = piece.encode()
        size, known = self.size, self.known
        last, counts = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - size[token]
                if not start or known[last[start] << _SHIFT | token]:
                    last[end], counts[end] = token, counts[start] + 1
        if len(raw) != len(piece):
            table = [c for c, b in zip(counts[1:], [*raw[1:], 0], strict=True) if b & 0xC0 != 0x80]
        else:
            table = counts[1:]
        if piece in PARTED:
            table[1] = 2
        return bytes(table) if len(table) < 64 else array("I", table)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings, as the library splits it."""
        if not self.odd(text):
            return self.split(text)
        ends = list(accumulate(map(len, self.split(text.translate(self.stand_ins)))))
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def units(self, text: str) -> tuple[list[str], list[int]]:
        """The pre-tokens and special strings of a text, and the places in the list of the latter."""
        if self.at_special is None or not self.at_special.search(text):
            return self.pieces(text), []
        out: list[str] = []
        special = []
        for k, part in enumerate(self.at_special.split(text)):
            if k % 2:
                special.append(len(out))
                out.append(part)
            else:
                out += self.pieces(part)
        return out, special

    def sizes(self, units: list[str], special: list[int]) -> list[int]:
        """Tokens of each unit."""
        out = [t[-1] for t in map(self.tables.__getitem__, units)]
        for k in special:
            out[k] = 1
        return out

    def inside(self, units: list[str], special: list[int], k: int, base: Sequence[int]) -> np.ndarray:
        """Counts at every prefix that ends in unit k, at its end too; ``base``: tokens before each unit."""
        unit, before = units[k], units[k - 1] if k and k - 1 not in special else ""
        if k in special:
            # Cut short, a special string is ordinary text, which may share a pre-token with what stands before.
            out = self.prefix_counts(before + unit[:-1])[len(before) + 1 :] + base[k - bool(before)]
            return np.append(out, base[k] + 1)
        out = np.array(list(self.tables[unit]), np.int64) + base[k]
        if before and unit[0] in self.spaces and before[-1] in self.spaces:
            # White space that ends a text is one pre-token; before a word its last character is not.
            out[0] = base[k - 1] + self.tables[before + unit[0]][-1]
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of the first 0, 1, 2, ... code points."""
        units, special = self.units(text)
        base = [0, *accumulate(self.sizes(units, special))]
        return np.concatenate([np.zeros(1, np.int64), *(self.inside(units, special, k, base) for k in range(len(units)))])

    def fitting(self, units: list[str], special: list[int], sizes: list[int], budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens; only units at its end are looked into."""
        base = [0, *accumulate(sizes)]
        if base[-1] <= budget:
            return sum(map(len, units))
        # The last unit before which there is room; the first prefixes of the next may share its tokens.
        k = int(np.searchsorted(base[:-1], budget - 1, side="right")) - 1
        if k < 0:
            return 0
        start = sum(map(len, units[:k]))
        counts = np.concatenate([[base[k]], *(self.inside(units, special, j, base) for j in range(k, min(k + 2, len(units))))])
        return start + int(np.flatnonzero(counts <= budget)[-1])


def read_spec(spark: SparkSession, path: str) -> dict:
    """A tokenizer's description: by Spark from a path with a scheme, else a file of the driver's library."""
    if "://" in path:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None, prefixes: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens) of every text, with ``fit_chars`` (code points of the longest prefix of at most
    ``budget`` tokens) and ``prefix_counts`` (counts of the first 0, 1, 2, ... code points) where asked for.

    One pass without a shuffle; memory is one Arrow batch and the memo.  The model is that of the
    vocabulary file, whatever the corpus.
    """
    spec = read_spec(df.sparkSession, path)
    key = sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(PrefixCounter(spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: PrefixCounter = worker_state(("token_counts", key), lambda: sent.value.ready())
        for whole in batches:
            for batch in slices(whole, 1):
                n_tokens, fits, tables = [], [], []
                for text in batch.column(1).to_pylist():
                    units, special = counter.units(text or "")
                    sizes = counter.sizes(units, special)
                    n_tokens.append(sum(sizes))
                    if budget is not None:
                        fits.append(counter.fitting(units, special, sizes, budget) if n_tokens[-1] > budget else len(text or ""))
                    if prefixes:
                        tables.append(counter.prefix_counts(text or "").astype(np.int32))
                    counter.tables.turn()
                columns = {"key": batch.column(0), "n_bytes": pc.coalesce(pc.binary_length(batch.column(1)).cast(pa.int64()), pa.scalar(0, pa.int64())), "n_tokens": pa.array(n_tokens, pa.int64())}
                columns |= {"fit_chars": pa.array(fits, pa.int64())} if budget is not None else {}
                columns |= {"prefix_counts": pa.array(tables, pa.list_(pa.int32()))} if prefixes else {}
                yield pa.RecordBatch.from_pydict(columns)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_tokens long" + ", fit_chars long" * (budget is not None) + ", prefix_counts array<int>" * prefixes
    out = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", id_col)


def tokens_of_prefix(prefix_counts: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points, from the stored table; null beyond the text."""
    return F.get(prefix_counts, chars if isinstance(chars, Column) else F.lit(chars))


def longest_prefix(prefix_counts: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from the stored table."""
    fits = F.transform(prefix_counts, lambda c, k: F.when(c <= budget, k))
    return F.array_max(fits)


def truncated(df: DataFrame, budget: int, text_col: str = "text") -> DataFrame:
    """Each text cut to its longest prefix within the budget, by its stored ``prefix_counts``."""
    return df.withColumn(text_col, F.substring(F.col(text_col), F.lit(1), longest_prefix(F.col("prefix_counts"), budget)))
