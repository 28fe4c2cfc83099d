"""Categorisers against hand-worked phrases and a plain re-derivation."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import colour as C

CASES = [
    ("flowers pinkish or white", "WHITE", "PINK"), ("flowers brilliant scarlet, yellow in centre", "YELLOW", "RED"), ("corolla mostly yellow with a dark purple centre", "YELLOW", "YELLOW"),
    ("petals violet", "PURPLE/BLUE", "PURPLE/BLUE"), ("no flower colour mentioned", "UNKNOWN", "UNKNOWN"), ("flowers white", "WHITE", "WHITE"), ("flowers greenish white", "WHITE", "WHITE"), ("flowers white or pink", "WHITE", "WHITE"),
    ("flowers yellowish green", "YELLOW", "YELLOW"), ("flowers greenish-yellow", "YELLOW", "YELLOW"), ("flowers orange", "OTHER", "YELLOW"), ("flowers cream-coloured", "RED", "YELLOW"), ("flowers rose-coloured", "RED", "OTHER"),
    ("flowers whitish", "WHITE", "WHITE"), ("flowers yellow or white", "WHITE", "YELLOW"), ("flowers bluish", "OTHER", "PURPLE/BLUE"),
    ("flowers lilac", "OTHER", "OTHER"), ("flowers scarlet", "OTHER", "RED"), ("scattered", "RED", "OTHER"), ("flowers green", "OTHER", "GREENISH"), ("creamy", "OTHER", "OTHER"), ("uncertain", "OTHER", "OTHER"),
    ("no flower colour mentioned; leaves red", "RED", "UNKNOWN"), ("", "UNKNOWN", "UNKNOWN"), ("  ", "UNKNOWN", "UNKNOWN"), (None, "UNKNOWN", "UNKNOWN"),
]


def run(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_hand_worked_phrases(spark):
    texts = [t for t, _, _ in CASES]
    assert run(spark, texts, C.categorise_v1) == [a for _, a, _ in CASES]
    assert run(spark, texts, C.categorise_v2) == [b for _, _, b in CASES]


def test_expansion_variant_tests_abstention_first(spark):
    assert run(spark, ["uncertain, maybe red", "no flower colour; white", "red", None], C.categorise_v1x) == ["UNKNOWN", "UNKNOWN", "RED", "UNKNOWN"]


def plain_v2(text):
    """The described behaviour, worked word by word: compounds first, then the earliest token."""
    if not (text or "").strip() or "no flower colour" in text.lower():
        return "UNKNOWN"
    t = text.lower()
    t = re.sub(r"\b(%s)[\s\-]+white\b" % "|".join(C.BEFORE_WHITE), "white", t)
    t = re.sub(r"\b(%s)[\s\-]+yellow\b" % "|".join(C.BEFORE_YELLOW), "yellow", t)
    t = re.sub(r"\bcream(-?coloured|-?colored)?\b", "yellow", t)
    t = re.sub(r"\borange\b", "yellow", t)
    found = [(m.start(), k, name) for k, (p, name) in enumerate(C.TOKENS) if (m := re.search(p, t))]
    return min(found)[2] if found else "OTHER"


WORDS = st.sampled_from("white whitish pale cream-coloured red reddish blue bluish green greenish yellow orange dull or and tinged violet crimson flowers cream scarlet pink".split())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(WORDS, min_size=1, max_size=6).map(" ".join), min_size=20, max_size=20))
def test_leftmost_token_agrees_with_plain_python(spark, texts):
    assert run(spark, texts, C.categorise_v2) == [plain_v2(t) for t in texts]


def test_class_map(spark):
    assert run(spark, ["Purple / Blue", "n/a", "GREENISH", " ", "white ", None, "PINK"], C.to_class) == ["REDTYPE", "UNKNOWN", "OTHER", "UNKNOWN", "WHITE", "UNKNOWN", "REDTYPE"]
    assert run(spark, ["GREENISH", "RED", None], C.to_group) == [None, "REDTYPE", None]


def test_keyword_rule(spark):
    assert run(spark, ["Leaves green. Flowers whitish; fruit red", "Leaves red.", "Flowers small. Petals golden.", None], C.keyword_extract) == ["flowers white", C.NOT_MENTIONED, "flowers yellow", C.NOT_MENTIONED]


def test_onehot_refuses_unknown(spark):
    assert run(spark, ["WHITE", "RED"][:1], lambda c: C.onehot(c, "WHITE")) == [1]
    with pytest.raises(Exception, match="not a known colour"):
        run(spark, ["UNKNOWN"], lambda c: C.onehot(c, "WHITE"))


def test_a_category_is_found_once_a_row(spark):
    from tessera.functions import text as X

    said = str(X.stratum(C.categorise_v2(F.col("t")), F.col("t")))
    assert said.count("regexp_extract") == 1
