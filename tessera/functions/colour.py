"""Colour categorisers, their class map and the keyword extractor, as column expressions.

Null and blank texts are UNKNOWN.  All expressions stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Needles of the substring categoriser, in order of priority.
PRIORITY = (
    (("white", "whitish"), "WHITE"),
    (("yellow", "golden"), "YELLOW"),
    (("pink", "pinkish"), "PINK"),
    (("red",), "RED"),
    (("purple", "purplish", "violet", "blue"), "PURPLE/BLUE"),
    (("greenish",), "GREENISH"),
)
ABSTAINED = "no flower colour"
# Colour tokens of the leftmost-token categoriser.
TOKENS = (
    ("whitish|white", "WHITE"),
    ("yellowish|yellow|golden", "YELLOW"),
    ("pinkish|pink", "PINK"),
    (r"scarlet|crimson|reddish|\bred\b", "RED"),
    (r"purplish|purple|violet|bluish|\bblue\b", "PURPLE/BLUE"),
    ("orange", "OTHER"),
    (r"greenish|\bgreen\b", "GREENISH"),
    ("cream", "OTHER"),
)
# Modifiers that a following colour word absorbs.
BEFORE_WHITE = "greenish yellowish creamy cream greyish grayish bluish pinkish purplish reddish pale dull bright dirty".split()
BEFORE_YELLOW = "greenish creamy cream pale dull bright dirty".split()
# The keyword extractor's terms and canonical words.
FLORAL = "flowers? petals? corolla perianth tepals? florets? blossoms?".split()
CANONICAL = {"whitish": "white", "white": "white", "yellowish": "yellow", "yellow": "yellow", "golden": "yellow", "pinkish": "pink", "pink": "pink", "purplish": "purple", "purple": "purple", "violet": "purple", "bluish": "blue", "blue": "blue", "reddish": "red", "scarlet": "red", "crimson": "red", "red": "red", "orange": "orange", "greenish": "greenish", "green": "greenish", "cream": "cream"}
NOT_MENTIONED = "no flower colour mentioned"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"^\s*$")


def _contains(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(n) for n in needles))


def _first_of(text: Column, rules: tuple, otherwise: str) -> Column:
    low = F.lower(text)
    chain = F.when(blank(text), "UNKNOWN")
    for needles, name in rules:
        chain = chain.when(_contains(low, needles), name)
    return chain.otherwise(otherwise)


def categorise_v1(text: Column) -> Column:
    """Substring priority; an abstention counts only where no colour word is."""
    return _first_of(text, (*PRIORITY, ((ABSTAINED,), "UNKNOWN")), "OTHER")


def categorise_v1x(text: Column) -> Column:
    """The same with abstentions, and ``uncertain``, tested first."""
    return _first_of(text, (((ABSTAINED, "uncertain"), "UNKNOWN"), *PRIORITY), "OTHER")


def compounds(text: Column) -> Column:
    """Lower case, with compound colours as the one word they mean."""
    low = F.lower(text)
    low = F.regexp_replace(low, rf"\b(?:{'|'.join(BEFORE_WHITE)})[\s\-]+white\b", "white")
    low = F.regexp_replace(low, rf"\b(?:{'|'.join(BEFORE_YELLOW)})[\s\-]+yellow\b", "yellow")
    low = F.regexp_replace(low, r"\bcream(?:\-?coloured|\-?colored)?\b", "yellow")
    return F.regexp_replace(low, r"\borange\b", "yellow")


def categorise_v2(text: Column) -> Column:
    """The leftmost colour token decides; no token is OTHER."""

    def named(token: Column) -> Column:
        chain = F.when(blank(text) | F.lower(text).contains(ABSTAINED), "UNKNOWN")
        for pattern, name in TOKENS:
            chain = chain.when(token.rlike(f"^(?:{pattern})$"), name)
        return chain.otherwise("OTHER")

    return once(F.regexp_extract(compounds(text), "|".join(p for p, _ in TOKENS), 0), named)


CATEGORISERS: dict[str, Callable[[Column], Column]] = {"v1": categorise_v1, "v1x": categorise_v1x, "v2": categorise_v2}


def to_class(fine: Column) -> Column:
    """Fine category or alias to analysis class; blank and null are UNKNOWN."""
    name = F.regexp_replace(F.upper(F.trim(F.coalesce(fine, F.lit("")))), " ", "")
    return (
        F.when(name.isin("WHITE", "YELLOW"), name)
        .when(name.isin("RED", "PINK", "PURPLE/BLUE", "PURPLEBLUE", "REDTYPE"), "REDTYPE")
        .when(name.isin("UNKNOWN", "NONE", "NA", "N/A", ""), "UNKNOWN")
        .otherwise("OTHER")
    )


def to_group(fine: Column) -> Column:
    """The analysis class of a known colour, else null."""
    found = to_class(fine)
    return F.when(found.isin("WHITE", "YELLOW", "REDTYPE"), found)


def with_abstention(text: Column, categorise: Callable[[Column], Column] = categorise_v2) -> Column:
    """Class of an extractor that may answer ``uncertain``, which is an abstention."""
    return F.when(F.lower(F.trim(text)) == "uncertain", "UNKNOWN").otherwise(to_class(categorise(text)))


def keyword_extract(description: Column) -> Column:
    """``flowers <colour>`` from the first sentence with a floral term and a colour word."""
    words = "|".join(CANONICAL)
    sentences = F.split(F.lower(description), r"[.;\n]")
    floral, coloured = rf"\b(?:{'|'.join(FLORAL)})\b", rf"\b({words})\b"
    hits = F.filter(sentences, lambda s: s.rlike(floral) & s.rlike(coloured))
    table = F.create_map(*(F.lit(x) for pair in CANONICAL.items() for x in pair))
    word = F.element_at(table, F.regexp_extract(F.get(hits, F.lit(0)), coloured, 1))
    return F.when(blank(description) | (F.size(hits) < 1), NOT_MENTIONED).otherwise(F.concat(F.lit("flowers "), word))


def onehot(group: Column, name: str) -> Column:
    """1 where the known class is ``name``, else 0; refuses any class that is not a known colour."""
    known = group.isin("WHITE", "YELLOW", "REDTYPE")
    return F.when(known, (group == name).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a known colour: "), F.coalesce(group, F.lit("null")))).cast("int"))
