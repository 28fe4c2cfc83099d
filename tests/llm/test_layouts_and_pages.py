"""Chat records with fields that no layout names; pages with odd markup and without an article element."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, html_text

RECORDS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    "messages-parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]},
    "share": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "turns": {"turns": [{"speaker": "human", "text": "q"}, {"speaker": "bot", "text": "a"}]},
    "dialog": {"dialog": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
    "instruction": {"instruction": "q", "output": "a"},
    "instruction-response": {"instruction": "q", "response": "a"},
    "prompt": {"prompt": "q", "completion": "a"},
    "prompt-response": {"prompt": "q", "response": "a"},
    "question": {"question": "q", "answer": "a"},
}
TURNS = [("user", "q"), ("assistant", "a")]


def test_every_layout_with_other_fields(spark):
    assert set(RECORDS) == {m.name for m in chat.MAPPINGS}
    extras = [{}, {"source": "web"}, {"meta": {"score": 0.5, "tags": ["x", "y"]}, "id": 7}, {"clean": [], "note": None}]
    rows = [(name, k, json.dumps({**record, **extra})) for name, record in RECORDS.items() for k, extra in enumerate(extras)]
    rows += [("none", 0, json.dumps({"what": 1})), ("none", 1, json.dumps({"what": 2})), ("none", 2, "no json"), ("none", 3, None)]
    df = chat.format_records(spark.createDataFrame(rows, "name string, k int, record string"))
    for r in chat.read_back(df).where("name <> 'none'").collect():
        assert r.mapping == r.name, (r.name, r.k)
        assert [(t.role, t.text) for t in r.turns] == TURNS and r.loss_text == "a"
    assert sorted(r.n for r in chat.unknown_layouts(df).collect()) == [2, 2] and chat.unknown_layouts(df).where("schema_hash IS NULL").count() == 1


def test_mixed_contents_tool_calls_and_odd_elements():
    record = {"messages": [{"role": "user", "content": "one"}, {"role": "user", "content": [{"type": "text", "text": "two"}, {"type": "image", "url": "u"}]}, {"role": "assistant", "content": None, "tool_calls": [{"id": "t", "function": {"name": "f"}}]}, "bare", {"role": "assistant", "content": "three"}], "model": "m"}
    _, name, turns = chat.canonical(json.dumps(record))
    assert name == "messages-parts" and turns == [("user", "one"), ("user", "two"), ("assistant", ""), ("", "bare"), ("assistant", "three")]
    assert chat.parse(chat.render(turns)[0]) == turns
    assert chat.canonical(json.dumps({"instruction": "i", "input": "x", "output": "o", "response": "r", "lang": "en"}))[1] == "instruction"


LONG = "This is a paragraph of main text with quite a few plain words in it, and some more after that."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><p title=O'Brien>FIRST {LONG} don't stop</p><p>{LONG}</p></body>", f"FIRST {LONG} don't stop {LONG}"),
        (f"<body><p title=it's data-x=1>FIRST {LONG}</p><p>it's {LONG}</p></body>", f"FIRST {LONG} it's {LONG}"),
        (f"<body><p class=\"a>b\" title='c>d'>{LONG}</p></body>", LONG),
        (f"<body><p a = \"x>\" / b=y/z>{LONG}</p></body>", LONG),
        (f"<body><p>{LONG} AT&<b>amp;</b>T and &lt;b&gt;</p></body>", f"{LONG} AT&amp;T and <b>"),
        (f"<body><p>{LONG} where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>{LONG}</p></body>", f"{LONG} where x=2 holds. {LONG}"),
        (f"<body><p>{LONG}</p><object data=x><p>shown instead {LONG}</p></object></body>", f"{LONG} shown instead {LONG}"),
        (f"<body><p>{LONG} <svg><text>label</text></svg> {LONG}</p></body>", f"{LONG} label {LONG}"),
    ],
)
def test_markup_by_the_standard(page, want):
    assert html_text.extract_text(page) == want


def test_blanks_are_no_words():
    menu = "<nav>" + "".join(f"<a href=/x{k}>Item number {k}</a>" for k in range(60)) + "</nav>"
    page = f"<body>{menu}<div>{' ' * 4000}only three words{' ' * 4000}</div><main><p>{LONG}</p><p>{LONG}</p></main></body>"
    assert LONG in html_text.extract_text(page) and "Item number" not in html_text.extract_text(page)


def test_pages_without_an_article_equal_their_paragraphs(spark):
    r = random.Random(9)
    words = "river stone light garden morning people bridge winter answer music paper window".split()
    rows = []
    for n in range(40):
        said = [" ".join(r.choice(words) for _ in range(r.randrange(20, 60))) for _ in range(r.randrange(2, 6))]
        pad = lambda: r.choice(["", "\n", "\n" + " " * r.randrange(900)])
        quote = r.choice(["", '"', "'"])
        body = "".join(f"{pad()}<p id={quote}p{k}{quote} data-note=it's>{pad()}{x}{pad()}</p>{pad()}" for k, x in enumerate(said))
        links = "".join(f"{pad()}<li><a href=/section/{k}?a='b>{r.choice(words)}</a></li>" for k in range(r.randrange(5, 25)))
        page = f"<html><head><title>{said[0]}</title></head><body>{pad()}<nav><ul>{links}</ul></nav>{pad()}<div class={quote}content{quote}>{body}</div>{pad()}<footer><p>All rights reserved {r.choice(words)}</p></footer></body></html>"
        rows.append((n, page, " ".join(said)))
    df = spark.createDataFrame(rows, "page_id int, html string, want string")
    out = html_text.extract(df)
    assert [(r.page_id, r.text) for r in out.where(F.col("text") != F.col("want")).collect()] == []


def test_attributes_cost_linear_time():
    for page in ("<p " + "a " * 200_000, "<p " + "a=\"b" * 100_000, "<p a='" + "x" * 300_000, "<p " + "=" * 200_000 + ">", "<p " + "a" * 300_000):
        start = time.perf_counter()
        html_text.extract_text(page)
        assert time.perf_counter() - start < 5, page[:20]
