"""Chat formatting, decontamination, HTML and URL filters: round trips, brute force, defined cases."""

import datetime
import html
import json
import os
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, html_text, queries, url_filter

TEXT = st.text(st.sampled_from("ab<|>\\ /end\n%7C2né"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=5))
def test_formatting_is_reversible(turns):
    shown, mask = chat.render(turns)
    assert chat.parse(shown) == turns
    assert [chat.unescape(shown[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_layouts():
    done = lambda r: chat.canonical(json.dumps(r))[1:]
    assert done({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}) == ("messages", [("user", "a"), ("assistant", "")])
    assert done({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}) == ("share", [("system", "s"), ("user", "a"), ("assistant", "b")])
    assert done({"instruction": "i", "input": "x", "output": "o"}) == ("instruction", [("user", "i\n\nx"), ("assistant", "o")])
    assert done({"instruction": "i", "input": "", "output": "o"})[1] == [("user", "i"), ("assistant", "o")]
    assert done({"prompt": "p", "completion": "c", "id": 3}) == ("prompt", [("user", "p"), ("assistant", "c")])
    assert done({"question": "q", "answer": "a", "context": "c"})[1] == [("user", "c\n\nq"), ("assistant", "a")]
    assert done({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]})[1] == [("user", "xy")]
    assert done({"turns": [{"speaker": "Bot", "text": "a"}]})[1] == [("assistant", "a")]
    assert done({"messages": [{"role": "gpt", "content": "a"}]})[1] == [("gpt", "a")]  # canonical roles are what they say
    assert done({"strange": 1}) == (None, []) and chat.canonical(None) == (None, None, []) and chat.canonical("{") == (None, None, [])
    assert chat.canonical("[1]") == (None, None, [])


def test_roles_of_rows_stay(spark):
    said = ["gpt", "human", "Assistant", "assistant", "model", "ai", "user", "", "<|end|>", "as|>sistant"]
    df = spark.createDataFrame([(1, k, r, f"t{k}") for k, r in enumerate(said)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_records(chat.gather(df))).first()
    assert [(t.role, t.text) for t in got.turns] == [(r, f"t{k}") for k, r in enumerate(said)] and got.loss_text == "t3"


def test_gathered_turns(spark):
    data = [(1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (2, 0, "user", None, "x"), (2, 0, None, "<|end|>", "x"), (2, 0, "user", None, "x"), (None, 5, "assistant", "t" * 50_000, "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_records(chat.gather(df))).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("", "<|end|>"), ("user", ""), ("user", "")], None: [("assistant", "t" * 50_000)]}
    assert chat.gather(df.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain_hits(docs, items, width=10):
    out = []
    for i, t in docs:
        w = plain_words(t)
        hit, found = set(), set()
        for item, text in items:
            b = plain_words(text)
            k = min(width, len(b))
            windows = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else set()
            for j in range(len(w) - k + 1):
                if k and tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def contamination_case():
    item = " ".join(f"q{k}" for k in range(25))
    items = [(1, item), (2, "Solo Ä9"), (3, None), (4, "!!"), (5, item.replace("q12", "zz")), (5, "tail words here")]
    docs = [(1, "pre " + item.upper() + ", post"), (2, "x solo-ä9 y SOLO Ä9"), (3, None), (4, ""), (5, " ".join(item.split()[:9])), (6, "a " + " ".join(item.split()[3:13]) + " b " + " ".join(item.split()[5:16])), (6, "tail   words\nhere" * 2), (7, "tail words"), (8, ("filler " * 3000) + item)]
    return docs, items


def report(found):
    return sorted(((r.doc_id, r.hit_words, sum(s.end - s.start for s in r.hit_spans), tuple(r.hit_items)) for r in found.collect()), key=str)


def test_hits_equal_brute_force(spark, monkeypatch):
    docs, items = contamination_case()
    d, b = spark.createDataFrame([(*x, "keep") for x in docs], "doc_id long, text string, hit_words string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(docs, items)
    assert report(decontaminate.find_windows(d, b)) == want
    assert report(decontaminate.find_windows(d, b, block_bytes=60)) == want  # block after block
    for name, value in (("PASS_BLOCKS", 2), ("BUFFER_BYTES", 100), ("BUILD_BYTES", 1)):
        monkeypatch.setattr(decontaminate, name, value)
    assert report(decontaminate.find_windows(d, b, block_bytes=60)) == want  # pass after pass
    assert report(decontaminate.find_windows(d, b.limit(0))) == [(i, n, 0, ()) for i, n, _, _ in want]
    assert decontaminate.find_windows(d.limit(0), b).count() == 0


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    plain = decontaminate._rolled
    monkeypatch.setattr(decontaminate, "_rolled", lambda ids, width: plain(ids, width) % np.uint64(3))
    items = [("1", "a b c d"), ("2", "b c d e a"), ("3", "c d"), ("4", "a b c d"), (None, "e a b")]
    windows = decontaminate._Windows(items, 3)
    words = "x a b c d e a b c d".encode().split()
    found = sorted((a, b, tuple(windows.items[k] or "-" for k in owners)) for a, b, _, owners in windows.scan(words, np.array([10, 1 << 62])))
    got = {(a, b): set() for a, b, _ in found}
    for a, b, owners in found:
        got[a, b] |= set(owners)
    assert got == {(1, 4): {"1", "4"}, (2, 5): {"1", "2", "4"}, (3, 6): {"2"}, (4, 7): {"2"}, (5, 8): {"-"}, (6, 9): {"1", "4"}, (7, 10): {"1", "2", "4"}, (3, 5): {"3"}, (8, 10): {"3"}}


def test_a_large_block_is_held_in_bounded_memory():
    r = np.random.default_rng(0)
    words = np.array([f"w{k}" for k in range(60_000)])
    items = [(str(k), " ".join(r.choice(words, 400))) for k in range(2000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    windows = decontaminate._Windows(items, 10)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 16 * size + (32 << 20) and peak < 30 * size + (64 << 20)
    said = items[77][1].encode().split()[5:30]
    assert {windows.items[k] for *_, owners in windows.scan(said, np.array([25, 1 << 62])) for k in owners} == {"77"}


def test_rolled_hashes_tell_windows_apart():
    words = [b"a", b"b", b"a", b"b", b"c"] * 3
    ids = decontaminate._word_ids(words)
    for k in range(1, 12):
        h = decontaminate._rolled(ids, k)
        assert len(h) == len(words) - k + 1
        windows = [tuple(words[i : i + k]) for i in range(len(h))]
        assert len(set(h.tolist())) == len(set(windows))
    assert len(decontaminate._rolled(ids[:3], 10)) == 0


def test_removal(spark):
    docs, items = contamination_case()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    cut = decontaminate.remove_spans(d, b)
    assert {r.doc_id: r.text for r in cut.collect()}[1] == "pre , post"
    assert sorted(str(r.doc_id) for r in decontaminate.drop_documents(d, b).collect()) == ["3", "4", "5", "6", "7"]  # one of the two rows of 6
    assert cut.columns == d.columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href=/a>Home</a></li></ul></nav></header><div class="cookie-notice"><p>We use cookies here</p></div>
<main><article><h1>Title &amp; more</h1><p>First <b>bo</b>ld para with a <a href=/y>link</a>.<p>Second&nbsp;para<br>line   two &lt;tag&gt;</p>
<div class="ad"><p>Buy now, it is so much better and cheaper than all else</p></div><aside><p>Related things</p></aside><ul><li>one<li>two</ul>
<form><label>Name</label><input name=x></form><table><tr><td>cell</td></tr></table><p>Third</p></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>Nice article, I have read it twice and liked it very much</p></div></section></main>
<aside class="sidebar"><p>Side text that is rather long but no part of it</p></aside><footer><p>&copy; Site</p></footer></body></html>"""


def test_main_text():
    assert html_text.extract_text(PAGE) == "Title & more First bold para with a link. Second para line two <tag> one two cell Third"


def test_plain_pages():
    assert html_text.extract_text("<p>hello <i>wor</i>ld</p><p>x") == "hello world x"
    assert html_text.extract_text("<div id=content><p>a b c</p><div class='share-links'><a href=x>tweet</a></div><p>d e</p></div><div id=footer><p>foot</p></div>") == "a b c d e"
    assert html_text.extract_text("<article><p>kept text <!-- cut off") == "kept text"
    assert html_text.extract_text("<article><p>kept text <script>var x") == "kept text"
    assert html_text.extract_text("<article><p>kept text <a hre") == "kept text"
    assert html_text.extract_text("<nav><a href=x>only menu</a></nav>") == "" and html_text.extract_text(None) == "" and html_text.extract_text("") == ""
    assert html_text.extract_text("<article>" + "<p>long words here</p>" * 3000 + "</article>").count("long") == 3000


def test_page_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    out = html_text.extract(df)
    assert sorted(r.text[:5] for r in out.collect()) == ["", "Title", "Title"] and html_text.extract(df.limit(0)).count() == 0


D = datetime.date


def plain_judgement(url, when, entries):
    """The longest pattern in force, from the history as it is written down."""
    m = re.match(r"[a-z]+://(?:[^/?#@]*@)?([^/?#:@]+)", (url or "").lower())
    if not m or when is None:
        return ("allow", None)
    host = re.sub(r"^www\.|\.$", "", m[1])
    seg = re.match(r"[A-Za-z]+://[^/?#]*/([^/?#]+)", url)
    labels = host.split(".")
    keys = [".".join(labels[i:]) for i in range(len(labels))]
    keys += [f"{k}/{seg[1]}" for k in keys] if seg else []
    best = ("allow", None)
    for k in keys:
        past = sorted((d, a) for p, a, d in entries if p == k and d is not None and d <= when)
        if past and past[-1][1] != "remove" and (best[1] is None or (len(k), k) > (len(best[1]), best[1])):
            best = (past[-1][1], k)
    return best


def test_history_decides(spark):
    entries = [("example.com", "block", D(2024, 1, 10)), ("example.com", "remove", D(2024, 2, 1)), ("a.example.com", "allow", D(2024, 1, 15)), ("example.com/x", "block", D(2024, 1, 5)), ("com", "block", D(2024, 3, 1)), ("com", "allow", D(2024, 3, 1)), (None, "block", D(2024, 1, 1)), ("org", "block", None)]
    urls = ["http://example.com/", "https://WWW.a.example.com:8080/x/y?q", "http://user@b.example.com/x", "http://example.com", "http://b.org/x", "notaurl", None, "http://example.com/x?y"]
    days = [D(2024, 1, 1), D(2024, 1, 10), D(2024, 1, 20), D(2024, 2, 1), D(2024, 3, 1), None]
    caps = [(i, u, d, "c") for i, (u, d) in enumerate((u, d) for u in urls for d in days)]
    df = spark.createDataFrame(caps + caps[:3], "id long, url string, fetched date, url_action string")
    lst = spark.createDataFrame(entries, "pattern string, action string, listed date")
    got = rows(url_filter.judge(df, lst).select("id", "url_action", F.coalesce("url_pattern", F.lit("-"))))
    want = sorted((i, a, p or "-") for i, u, d, _ in caps + caps[:3] for a, p in [plain_judgement(u, d, entries)])
    assert got == want
    assert {r.url_action for r in url_filter.judge(df, lst.limit(0)).collect()} == {"allow"} and url_filter.judge(df.limit(0), lst).count() == 0


@pytest.mark.parametrize("opening", ['<div class="container with-sidebar">', '<article class="post has-sidebar comments-open">', '<main class="no-sidebar">', '<div class="sidebar-right wrapper">'])
def test_a_part_of_a_wrappers_class_does_not_hide_the_article(opening):
    said = " ".join(f"<p>{'some words of the long main text here ' * 6}</p>" for _ in range(4))
    close = f"</{opening[1:].split()[0]}>"
    page = f'<body>{opening}{said}<div class="cookie-notice"><p>We use cookies</p></div>{close}<div class="site-footer"><p>All rights reserved</p></div></body>'
    found = html_text.extract_text(page)
    assert found.count("main text") == 24 and "cookies" not in found and "rights" not in found


def test_weights_are_learned_from_labelled_pages():
    pages = html_text.labelled_pages()
    learned = html_text.Extractor(html_text.learn(pages[: len(pages) // 2]))
    right = found = wanted = 0
    for page in pages[len(pages) // 2 :]:
        got = Counter(learned.text(page).split())
        want = Counter(w for t, main, _ in html_text.labelled_runs(page) if main for w in t.split())
        right, found, wanted = right + (got & want).total(), found + got.total(), wanted + want.total()
    assert wanted > 4000 and right / found > 0.98 and right / wanted > 0.98
    nothing = html_text.Extractor(html_text.learn([]))
    assert "Home" in nothing.text("<nav><a href=x>Home</a></nav>")  # without pages no element says anything


def test_tags_without_partners_are_read_in_linear_time():
    n = 60_000
    for page in ("<div>" * n + "</p>" * n, "<b><table>" + "<div>" * n + "</b>" * n, "<p>" * n, "<li>" * n + "</ul>" * n, "<div><span>" * n + "<p></div>" * n, "<table><tr><td>" * n + "</b>" * n):
        start = time.perf_counter()
        html_text.extract_text(page)
        assert time.perf_counter() - start < 5, page[:20]


def plain_article(page):
    """The article of a page of the tables: markup taken out, blocks joined."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)
    if not body:
        return ""
    blocks = re.split(r"</?(?:p|h1|br|li|ul|div)[^>]*>", body[1])
    return " ".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))


DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
def test_query_finds_the_articles_of_the_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = queries.op9_html(spark, DIR).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert [r.page_id for r in got if r.text != plain_article(pages[r.page_id] or "")] == []


def test_memory_of_one_operator_is_given_back_to_the_next(monkeypatch):
    from tessera.llm import common

    given = []
    monkeypatch.setattr(common, "_STATE", {})
    monkeypatch.setattr(common, "_give_back", lambda: given.append(1))
    for key in ("a", "a", "b", "b"):
        common.worker_state(key, dict)
    assert given == [1] and list(common._STATE) == ["b"]
