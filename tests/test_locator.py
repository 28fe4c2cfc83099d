"""The automaton locator against a search of every name in the whole text."""

import random
import re
import time

import pytest

from tessera.operators import locator as L


def brute(text, genus, epithet):
    """Every mention, overlapping ones too, by a pattern of the one name; windows are cut from the text."""
    if not (text and genus and epithet):
        return None
    low = L.folded(text)
    name = rf"(?=\b((?:{re.escape(genus.lower())}|{re.escape(genus[0].lower())}\.?)\s+{re.escape(epithet.lower())}\b))"
    best, most = None, 0
    for m in re.finditer(name, low):
        window = text[m.end(1) : m.end(1) + 2200]
        cut = re.search(L.BOUNDARY, window)
        window = window[: cut.start()] if cut else window
        head = window[:400]
        if not window or sum(map(str.isdigit, head)) > 0.22 * len(head):
            continue
        terms = len({t.group().lower() for t in re.finditer(L.MORPH, window, re.I)})
        if terms > most:
            best, most = window, terms
    return best if most >= 3 else None


WORDS = "Herbs erect leaves ovate stems racemes glabrous Flowers white red petals hairs seeds seed and of in Fig. 3 12, 13, Rosa R. ROSA alba nigra Acacia A. indica".split()


def made_text(r, n):
    out = []
    for _ in range(n):
        x = r.random()
        out.append("\n12. Rosa alba\n" if x < 0.02 else "\nROSACEAE FAMILY\n" if x < 0.03 else "1 2 3 4 5 6 7 8 " if x < 0.05 else r.choice(WORDS) + r.choice([" ", " ", " ", "  ", "\n", ", "]))
    return "".join(out)


NAMES = [("Rosa", "alba"), ("Rosa", "nigra"), ("Acacia", "alba"), ("Acacia", "indica"), ("Rubus", "alba"), ("Rosa", "rosa"), ("Foo-bar", "alba"), ("Rosa alba", "nigra"), ("X", "erect"), ("", "alba"), ("Rosa", "")]


def test_one_text_equals_a_search_by_name():
    r = random.Random(1)
    for _ in range(150):
        text = made_text(r, r.choice([5, 60, 700]))
        for genus, epithet in NAMES:
            assert L.locate(text, genus, epithet) == brute(text, genus, epithet), (text, genus, epithet)
    for text in ["Foo-bar alba herbs leaves stems x", "xRosa alba herbs leaves stems", "Rosa albax herbs leaves stems", "rosa\n \talba herbs leaves stems", "R.alba herbs leaves stems", "_R. alba herbs leaves stems", "Rosa alba herbs leaves " + "x" * 2175 + " seeds and stems", "Rosa alba" + " herbs leaves" + "," * 2183 + "stems"]:
        for genus, epithet in NAMES:
            assert L.locate(text, genus, epithet) == brute(text, genus, epithet), (text, genus, epithet)


def test_best_window_and_no_index():
    good = "Herbs with ovate leaves and erect stems; racemes glabrous. Flowers white in panicles."
    text = f"Rosa alba 12, 13, 14, 15, 16, 17, 18, 19, 20\n\n{' ' * 10}R. alba {good}"
    assert "racemes" in L.locate(text, "Rosa", "alba")
    assert L.locate(text, "Rosa", "nigra") is None and L.locate(None, "Rosa", "alba") is None


def test_colour_by_places():
    assert L.colour_on_organ("Leaves with white hairs. " + "x" * 60 + " Flowers yellow here") == "yellow"
    assert L.colour_on_organ("White " + "x" * 80 + " flowers") is None and L.colour_on_organ("") is None
    assert L.colour_on_organ("petals Purple") == "purple"


def asked(spark, names, texts):
    n = spark.createDataFrame([(*x, "old") for x in names], "volume string, genus string, epithet string, status string")
    t = spark.createDataFrame(texts, "volume string, page string, text string, window string")
    out = L.locate_treatments(n, t, "volume", "text", "genus", "epithet", "page")
    assert out.columns == ["volume", "genus", "epithet", "window", "colour", "status"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_volumes_of_several_texts_in_chunks_and_blocks(spark, monkeypatch, small):
    if small:
        for name, value in {"CHUNK": 700, "CELL_CHARS": 3000, "CELL_NAMES": 4, "FEW_VOLUMES": 0}.items():
            monkeypatch.setattr(L, name, value)
    r = random.Random(2)
    texts = [("1", "a", made_text(r, 500), ""), ("1", "b", made_text(r, 900), ""), ("2", "a", made_text(r, 40), ""), ("2", "b", None, ""), ("2", "c", "", ""), (None, "a", made_text(r, 90), ""), ("4", "a", "nothing", "")]
    names = [(v, *x) for v in ("1", "2", "3", "4", None) for x in NAMES] + [("1", None, "alba"), ("1", "Rosa", None), ("1", "Rosa", "alba"), ("1", "Rosa", "alba")]
    want = []
    for v, g, e in names:
        windows = [brute(t, g, e) for w, _, t, _ in sorted(texts, key=str) if w is not None and w == v]
        count = lambda w: len({t.group().lower() for t in re.finditer(L.MORPH, w, re.I)})
        window = max((w for w in windows if w is not None), key=count, default=None)
        colour = L.colour_on_organ(window)
        want.append((v, g, e, window, colour, "not_located" if window is None else "RECOVERABLE" if colour else "located_no_colour"))
    assert asked(spark, names, texts) == sorted(want, key=str)
    assert asked(spark, [], texts) == [] and asked(spark, names[:1], []) == [(*names[0], None, None, "not_located")]


def test_names_cost_little():
    r = random.Random(3)
    text = made_text(r, 60_000)
    took = []
    for many in (100, 10_000):
        names = L.Names([("Rosa", "alba"), *((f"Genus{k}", f"epithet{k}") for k in range(many))])
        began = time.process_time()
        L.best_windows(names, text, -1, len(text))
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.5


def test_long_runs_of_white_space_end():
    began = time.process_time()
    assert L.locate("Rosa alba herbs leaves stems" + "\n" * 30_000 + "x", "Rosa", "alba") is not None
    assert time.process_time() - began < 20
