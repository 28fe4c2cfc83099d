"""Text, name and label functions of the evidence pipeline, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.colour import once


def whitespace_normal(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_key(name: Column) -> Column:
    """Case- and space-insensitive key of a binomial; null is empty."""
    return F.lower(whitespace_normal(F.coalesce(name, F.lit(""))))


def first_token(name: Column) -> Column:
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"^\s*(\S+)", 1)


def file_safe(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


def volume_of(path: Column) -> Column:
    """The volume number in a file name."""
    return F.regexp_extract(path, r"(?i)VOL\.?\s*(\d+)", 1)


def truth(value: Column) -> Column:
    """Tolerant boolean of text: TRUE, 1, YES in any case; null is false."""
    return F.coalesce(F.upper(F.trim(value.cast("string"))).isin("TRUE", "1", "YES"), F.lit(False))


def flag_clear(flag: Column) -> Column:
    """Tri-state flag: null and false pass."""
    return ~F.coalesce(flag, F.lit(False))


def number_in(text: Column, pattern: str) -> Column:
    """First captured number of a printed text, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")


def left(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def tokens(text: Column) -> Column:
    """Runs of three or more ASCII letters, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{3,})"), 1)


# Terms of the description score (case matters).
HABIT = "Herbs?|Shrubs?|Under-?shrubs?|Trees?|Climbers?|Twiners?|Lianas?|Epiphytes?|Subshrubs?|Perennial|Annual|Biennial"
MORPH = "Leaves|Flowers?|Sepals?|Petals?|Stems?|Corolla|Calyx|Inflorescence|Fruits?|Seeds?|Follicles?|Stamens?|Ovary|Rhizome"
SECTION = r"(Fl\.|Fr\.|Distrib|Fig\.)"


def has_habit(block: Column) -> Column:
    return F.substring(block, 1, 80).rlike(rf"\b(?:{HABIT})\b")


def description_score(block: Column) -> Column:
    """2 for a habit in the first 80 characters, 1 a part named up to 4, 1 for a section mark."""
    named = F.regexp_count(block, F.lit(rf"\b(?:{MORPH})\b"))
    return F.when(has_habit(block), 2).otherwise(0) + F.least(named, F.lit(4)) + F.when(block.rlike(SECTION), 1).otherwise(0)


def strong_description(block: Column) -> Column:
    return has_habit(block) & block.rlike(SECTION)


def epithet_lead(token: Column) -> Column:
    """Leading lower-case word of a token, without hyphens at its end; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(token, "^([a-z][a-z-]{2,})", 1), "-+$", ""), F.lit(""))


# The patterns and messages of the junk flags.
HEADING_NUMBER, LOWER_WORD, FULL_GENUS, ABBREVIATED_GENUS = r"^\s*\d+\.?\s*", "^[a-z][a-z-]{2,}", "^[A-Z][a-z]{2,}$", r"^[A-Z]\.?$"
COMMON_NOUN = "(?i)^(Shrubs?|Herbs?|Trees?|Leaves|Flowers?|Stems?|Fruits?|Seeds?)[,.]?$"
NO_HEADING = "AUTO-FLAG: species_id is not a real taxon heading (matched mid-description text) - verify the row before labelling, may need to re-check raw text"
ABBREVIATED = "AUTO-FLAG: abbreviated genus ('%s') - this is likely a duplicate identification-key stub, not the real species treatment; the full name may appear elsewhere in the volume"
GARBLED = "AUTO-FLAG: species_id looks garbled/non-taxonomic (genus token='%s') - verify before labelling"
GENUS_HEADER = "AUTO-FLAG: possible genus-level header (epithet token='%s', not lowercase) - likely describes the whole genus, not one species"
NO_EPITHET = "AUTO-FLAG: could not find a second token (epithet) - inspect species_id manually"
SHORT = "AUTO-FLAG: very short description snippet - may lack real info"
SHORT_SNIPPET = 60


def junk_flags(name: Column, snippet: Column) -> Column:
    """Reasons why a row's name is no species, joined by `` | ``; empty if there is none."""
    plain = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), HEADING_NUMBER, ""))
    genus, epithet = F.regexp_extract(plain, r"^(\S+)", 1), F.regexp_extract(plain, r"^\S+\s+(\S+)", 1)
    lower, full, named = epithet.rlike(LOWER_WORD), genus.rlike(FULL_GENUS), (genus != "") & (epithet != "")
    first = (
        F.when(genus.rlike(COMMON_NOUN), NO_HEADING)
        .when(genus.rlike(ABBREVIATED_GENUS), F.format_string(ABBREVIATED, genus))
        .when(named & ~lower & ~full, F.format_string(GARBLED, genus))
        .when(named & ~lower, F.format_string(GENUS_HEADER, epithet))
        .when(epithet == "", NO_EPITHET)
    )
    short = F.when(F.length(F.trim(F.coalesce(snippet, F.lit("")))) < SHORT_SNIPPET, SHORT)
    return F.concat_ws(" | ", first, short)


# Substrings that make a phrase ambiguous.
HINTS = (" to ", "tinged", " or ", "pale", "variable", "sometimes", "becoming", "turning", "then", "streak", "veined")


def stratum(category: Column, phrase: Column) -> Column:
    """Sampling stratum of a labelled phrase; null for categories that are not sampled."""
    hinted = once(F.lower(F.coalesce(phrase, F.lit(""))), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(h)) for h in HINTS)))

    def named(known: Column) -> Column:
        return (
            F.when(known == "UNKNOWN", "no_mention")
            .when(hinted, "ambiguous")
            .when(known == "WHITE", "clear_white")
            .when(known == "YELLOW", "clear_yellow")
            .when(known.isin("RED", "PINK", "PURPLE/BLUE"), "clear_redtype")
        )

    return once(category, named)


# Names of soil variables.
SOIL = ("bdod", "cec", "nitrogen", "phh2o", "soc", "ocd", "ocs", "clay", "silt", "sand", "cfvo")


def variable_family(name: Column) -> Column:
    """Family of an environmental variable; ranges are tested in this order."""
    number = F.regexp_extract(name, "^bio(\\d+)$", 1).try_cast("int")
    return (
        F.when(number.between(2, 5) | (number == 15), "Seasonality")
        .when(number.between(1, 11), "Temperature")
        .when(number.between(12, 19), "Precipitation")
        .when(name.isin(*SOIL), "Soil")
        .otherwise("Others")
    )


def cut(value: Column, breaks: list[float], labels: list[str] | None = None) -> Column:
    """Right-closed bands of rising inner breaks; labels default to 1, 2, ...; null stays null."""
    names = labels or [str(k + 1) for k in range(len(breaks) + 1)]
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for b, name in zip(breaks, names, strict=False):
        chain = chain.when(value <= b, name)
    return chain.otherwise(names[-1])


ELEVATION = [500.0, 1500.0, 3000.0, 4500.0]


def pmcmc_floor(positive: Column, n: Column) -> Column:
    """Two-sided posterior tail, floored at half a draw before doubling."""
    return 2 * F.greatest(F.lit(0.5) / n, F.least(positive, 1 - positive))
