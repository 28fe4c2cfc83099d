"""Token counts of prefixes against the library, periodic runs against brute force."""

import json
import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import periodic, queries, token_counts

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return token_counts.PrefixCounter(json.load(f)).ready()


def check_prefixes(counter, library, text):
    want = [library(text[:k]) for k in range(len(text) + 1)]
    assert counter.prefix_counts(text).tolist() == want, text
    units, special = counter.units(text)
    sizes = counter.sizes(units, special)
    assert sum(sizes) == want[-1]
    for budget in {0, 1, 2, 3, 7, want[-1] // 2, want[-1]}:
        assert counter.fitting(units, special, sizes, budget) == max(k for k, c in enumerate(want) if c <= budget), (text, budget)


def test_every_prefix_where_a_cut_changes_the_pieces(counter, library):
    for text in ["don't we're they'll 've'", "!'re 'rest ''s", "a   b  c\n\n\nd  \n e ", " \n", "x\x1c\x1d y\x85z　 ", "été 汉字テスト emoji 😀👍", "½² Ⅷ٣", "a" * 60, "ab" * 40, " " * 30 + "x"]:
        check_prefixes(counter, library, text)


def test_special_strings_are_tokens_and_cut_ones_are_text(counter, library):
    for text in ["hi!!<|endoftext|> x", "  <|endoftext|><|endoftext|>  y<|endo", "<|endoftext|>", "a<|<|endoftext|>|>"]:
        check_prefixes(counter, library, text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", " ", "  ", "\n", "!", "'", "a", "n't", "'ll", "é", "😀", "12", "the"]), max_size=12).map("".join))
def test_prefixes_of_mixed_texts(counter, library, text):
    check_prefixes(counter, library, text)


@settings(max_examples=80, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_prefixes_of_any_text(counter, library, text):
    check_prefixes(counter, library, text)


def test_code_points_that_engines_class_otherwise(counter, library):
    points = sorted({*counter.stand_ins, *random.Random(1).sample([x for x in range(0x110000) if not 0xD800 <= x < 0xE000], 2000)})
    for form in ("a{0}1 {0}x", "1{0} {0}{0}\n{0}!", " {0}' {0}"):
        for x in points[::3]:
            text = form.format(chr(x))
            assert counter.prefix_counts(text)[-1] == library(text), hex(x)


def test_bounded_memos_change_nothing(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 5)
    monkeypatch.setattr(token_counts, "MEMO_PAIRS", 3)
    for k in range(60):
        text = f"word{k} other{k % 7} thing and more"
        assert counter.prefix_counts(text)[-1] == library(text)
        counter.tables.turn()
        assert len(counter.tables) <= 5 + 12 and len(counter.known) <= 3


def test_other_kinds_of_tokenizer_are_refused():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        token_counts.PrefixCounter(json.load(f))


def test_table_of_counts_and_questions_to_it(spark, library):
    long = "".join(random.Random(2).choice("etaoin shrdlu") for _ in range(30_000)) + "x" * 5000
    rows = [(1, None), (2, ""), (3, "the  cat's whiskers"), (3, "the  cat's whiskers"), (None, "a b"), (4, long), (5, "z" * 200_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string")
    out = token_counts.count_tokens(df, PATH, budget=3, prefixes=True)
    got = sorted(out.collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == [(None, 3, 2), (1, 0, 0), (2, 0, 0)] + [(3, 19, library("the  cat's whiskers"))] * 2 + [(4, len(long), library(long)), (5, 200_000, library("z" * 200_000))]
    assert got[1].prefix_counts == [0] and got[3].prefix_counts == [library("the  cat's whiskers"[:k]) for k in range(20)]
    assert got[3].fit_chars == max(k for k, c in enumerate(got[3].prefix_counts) if c <= 3)
    asked = out.select("doc_id", "fit_chars", token_counts.longest_prefix(F.col("prefix_counts"), 3).alias("fits"), token_counts.tokens_of_prefix(F.col("prefix_counts"), 4).alias("four"), token_counts.tokens_of_prefix(F.col("prefix_counts"), F.lit(10**6)).alias("beyond")).collect()
    assert all(r.fit_chars == r.fits and r.beyond is None for r in asked) and {r.four for r in asked if r.doc_id == 3} == {library("the ")}
    texts = spark.createDataFrame([(3, "the  cat's whiskers"), (7, None)], "doc_id long, text string")
    cut = token_counts.truncated(texts.join(out.dropDuplicates(["doc_id"]).select("doc_id", "prefix_counts"), "doc_id", "left"), 3)
    assert {r.doc_id: r.text for r in cut.collect()} == {3: "the  cat's whiskers"[: got[3].fit_chars], 7: None}
    assert token_counts.count_tokens(df.limit(0), PATH, budget=3, prefixes=True).count() == 0


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_equal_brute_force_for_any_bound_between_frequent_and_rare():
    r = random.Random(4)
    for _ in range(800):
        n, kinds = r.randrange(70), r.choice([1, 2, 3, 9])
        w = [r.randrange(kinds) for _ in range(n)]
        if n and r.random() < 0.7:
            a = r.randrange(n)
            p = 1 + r.randrange((n - a) // 3 + 1)
            w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
        want = brute_runs(w)
        for bound in (None, 0.5, 3, 1000):
            assert periodic.runs_of(periodic.numbered([str(x) for x in w]), bound) == want


def test_lag_counts_are_exact(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 50)
    ids = np.random.default_rng(5).zipf(1.5, 3000) % 200
    want = [0] + [int((ids[:-q] == ids[q:]).sum()) for q in range(1, 751)]
    for bound in (0.5, 20, None, 10**6):
        assert periodic.equal_pairs(ids, 750, bound)[1:].tolist() == want[1:]


def test_very_long_texts_of_one_pattern_are_scanned_at_one_lag(monkeypatch):
    scanned = []
    islands = periodic._islands
    monkeypatch.setattr(periodic, "_islands", lambda ids, q, need: scanned.append(q) or islands(ids, q, need))
    ids = np.arange(400_000) % 3
    assert periodic.runs_of(ids) == [(0, 400_000, 3)] and scanned == [3]


def brute_row(doc_id, text):
    w = periodic.WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
    head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    digest = lambda x: sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *head, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in dropped)))


def test_run_query_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(1, 60)))) for i in [*planted, *range(400, 440)]]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "x " * 50), (503, "x " * 50), (504, "a\x0bb　c\x0cd " * 30), (None, "y y y y y y y"), (planted[0] + 0, "")]
    spark.createDataFrame([(*row, "s") for row in rows], "doc_id long, text string, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op13_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(out.dtypes)["exponent_milli"] == dict(out.dtypes)["start"] == "bigint"
    assert sorted(map(tuple, out.collect()), key=str) == sorted((brute_row(*row) for row in rows), key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find_runs(empty).count() == 0
