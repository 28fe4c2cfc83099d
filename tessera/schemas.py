"""Closed label domains and the table schemas of the evidence pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

# Label domains, in their order of display.
FINE = ("WHITE", "YELLOW", "PINK", "RED", "PURPLE/BLUE", "GREENISH", "OTHER", "UNKNOWN")
CLASSES = ("WHITE", "YELLOW", "REDTYPE", "UNKNOWN", "OTHER")
KNOWN = ("WHITE", "YELLOW", "REDTYPE")
KNOWN_FINE = ("WHITE", "YELLOW", "RED", "PINK", "PURPLE/BLUE")
ERRORS = ("JUNK_NON_SPECIES", "CONTAMINATION", "CATEGORY_PRIORITY", "FRUIT_BERRY_COLOR", "FALSE_POSITIVE", "FALSE_NEGATIVE", "MULTI_COLOUR", "INDUMENT_TEXTURE", "OTHER_MISMATCH", "CORRECT")
RECOVERY = ("RECOVERABLE", "located_no_colour", "not_located")
DESIGNATIONS = ("robust", "same_direction_interval_changes", "label-sensitive")
AUDIT = ("PASS", "FAIL", "PEND")
FETCH = ("no_match", "no_records", "no_clean_records", "success", "error")


def strings(*names: str) -> T.StructType:
    """A schema of string columns; what a CSV file holds before any value is read."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TREATMENTS = strings("species_id", "volume", "genus", "epithet", "binomial", "raw_text").add("has_description", T.IntegerType())
PREDICTIONS = strings("species_id", "flower_color_free_text")
RETRIEVED = strings("species_id", "flower_color_free_text").add("n_demos", T.IntegerType()).add("demo_answers", T.StringType())
CATEGORIES = strings("species_id", "volume", "flower_color_free_text", "color_category", "genus", "epithet", "binomial", "has_description")
SPECIES_ONLY = strings("species_id", "volume", "flower_color_free_text", "color_category", "genus", "epithet", "is_species_level")
GOLD = strings("species_id", "volume", "stratum", "qwen_free_text", "qwen_category", "raw_text_snippet", "gold_free_text", "gold_category", "notes")
OCCURRENCES = T.StructType([T.StructField("species", T.StringType()), T.StructField("decimalLatitude", T.DoubleType()), T.StructField("decimalLongitude", T.DoubleType()), T.StructField("year", T.IntegerType()), *strings("countryCode", "gbifID").fields, T.StructField("hasGeospatialIssues", T.BooleanType()), *strings("query_name", "color_category", "color_group").fields])
DRAWS = T.StructType([T.StructField("subset", T.StringType()), T.StructField("color", T.StringType()), T.StructField("effect", T.StringType()), T.StructField("chain", T.IntegerType()), T.StructField("iter", T.IntegerType()), T.StructField("value", T.DoubleType())])
MANIFEST = T.StructType([T.StructField("task_id", T.IntegerType()), *strings("variant", "dataset_path", "color_label", "response_col").fields, T.StructField("chain", T.IntegerType()), T.StructField("seed", T.IntegerType())])
CHECKS = strings("section", "name", "got", "want", "detail", "status")
