"""The driver's tables in the roles of the evidence pipeline, in Spark and in SQL alike.

``phrases``: literal flower phrases and part names (id, txt); ``scored``: labelled documents with the
answers of three rules (doc_id, model, gold, pred); ``draws``: event values as chains of draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import table

#: Phrases that cover every branch of the categorisers (fixed values of the tests as well).
PHRASES = (
    "flowers greenish white", "flowers white or pink", "flowers pinkish or white", "flowers yellowish green", "flowers greenish-yellow", "flowers orange", "flowers cream-coloured", "flowers rose-coloured", "flowers whitish", "flowers yellow or white",
    "flowers bluish", "flowers lilac", "flowers scarlet", "scattered", "flowers green", "creamy", "uncertain", "no flower colour mentioned; leaves red", "", "   ", "flowers brilliant scarlet, yellow in centre", "corolla mostly yellow with a dark purple centre", "petals violet",
    "no flower colour mentioned", "flowers white", "pale yellow", "Golden petals", "dirty white bracts", "crimson tinged pale", "greenish",
)
_LITERAL = ", ".join(f"('t{k:03d}', '{p}')" for k, p in enumerate(PHRASES))
PHRASE_SQL = f"phrases AS (SELECT * FROM (VALUES {_LITERAL}) v(id, txt) UNION ALL SELECT 'p' || p_partkey, p_name FROM part)"


def phrases(spark: SparkSession, d: str) -> DataFrame:
    literal = spark.createDataFrame([(f"t{k:03d}", p) for k, p in enumerate(PHRASES)], "id string, txt string")
    return literal.unionByName(table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("txt")))


#: Gold classes from label pairs, answers by three rules on length and source.
GOLD_SQL = """gold AS (
  SELECT d.doc_id, d.source, d.n_chars, d.lang,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'WHITE' WHEN quality = 0 AND toxic = 0 THEN 'YELLOW' WHEN quality = 1 THEN 'REDTYPE' ELSE 'UNKNOWN' END AS gold
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
scored AS (
  SELECT doc_id, model, gold, pred, n_chars FROM (
    SELECT *, 'length' AS model, CASE WHEN n_chars < 300 THEN 'YELLOW' WHEN n_chars % 11 = 0 THEN 'REDTYPE' WHEN n_chars % 13 = 0 THEN 'UNKNOWN' ELSE 'WHITE' END AS pred FROM gold
    UNION ALL SELECT *, 'source' AS model, CASE WHEN source IN ('src1', 'src2') THEN 'REDTYPE' WHEN source = 'src3' THEN 'OTHER' WHEN n_chars % 7 = 0 THEN 'YELLOW' ELSE 'WHITE' END AS pred FROM gold
    UNION ALL SELECT *, 'mixed' AS model, CASE WHEN doc_id % 5 = 0 THEN 'UNKNOWN' WHEN n_chars % 3 = 0 THEN gold ELSE 'WHITE' END AS pred FROM gold) u)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", "lang")
    joined = table(spark, d, "labels").join(docs, "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    gold = F.when((q == 1) & (t == 0), "WHITE").when((q == 0) & (t == 0), "YELLOW").when(q == 1, "REDTYPE").otherwise("UNKNOWN")
    n, s = F.col("n_chars"), F.col("source")
    by_length = F.when(n < 300, "YELLOW").when(n % 11 == 0, "REDTYPE").when(n % 13 == 0, "UNKNOWN").otherwise("WHITE")
    by_source = F.when(s.isin("src1", "src2"), "REDTYPE").when(s == "src3", "OTHER").when(n % 7 == 0, "YELLOW").otherwise("WHITE")
    mixed = F.when(F.col("doc_id") % 5 == 0, "UNKNOWN").when(n % 3 == 0, F.col("gold")).otherwise("WHITE")
    base = joined.withColumn("gold", gold)
    answers = F.array(*(F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in (("length", by_length), ("source", by_source), ("mixed", mixed))))
    return base.select("doc_id", "gold", "n_chars", F.inline(answers)).select("doc_id", "model", "gold", "pred", "n_chars")


#: Draws: an effect is an event type, a chain a third of the users, an iteration the event's number.
DRAW_SQL = "draws AS (SELECT event_type AS effect, (user_id % 3)::INTEGER + 1 AS chain, event_id AS iter, value - 50 AS value FROM events)"


def draws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("effect"), ((F.col("user_id") % 3).cast("int") + 1).alias("chain"), F.col("event_id").alias("iter"), (F.col("value") - 50).alias("value"))


#: Environment: a part is a species, its lines are its records, its size is its elevation.
ENV_SQL = "env AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS genus, CASE WHEN p_name LIKE 'red%' OR p_name LIKE 'hot%' THEN 'REDTYPE' WHEN p_name LIKE 'new%' OR p_name LIKE 'small%' THEN 'YELLOW' ELSE 'WHITE' END AS color_group, p_size * 100.0::DOUBLE AS alt, p_retailprice FROM part)"


def env(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    group = F.when(name.startswith("red") | name.startswith("hot"), "REDTYPE").when(name.startswith("new") | name.startswith("small"), "YELLOW").otherwise("WHITE")
    return table(spark, d, "part").select("p_partkey", F.element_at(F.split(name, " "), 2).alias("genus"), group.alias("color_group"), (F.col("p_size") * 100.0).alias("alt"), "p_retailprice")
