"""The registered queries of the training-data operators, with SQL twins where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, hard_negatives, html_text, jaccard, langid, periodic, sharding, token_counts, toxicity, url_filter, vector_dedup
from tessera.llm.common import held_out


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, outputs=("ids_sha256", "decoded_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    keys = docs.select("doc_id", sharding.size_bytes(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32"))
    placed = sharding.shard_rows(keys, sharding.id_bucket(F.col("doc_id"), F.col("text_crc32")), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _read(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    predicted = (F.col("toxicity") >= toxicity.THRESHOLD).cast("int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: A conversation whose texts look like another template's control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    back = chat.read_back(chat.format_records(chat.gather(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_windows(docs, _read(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_count()
    items = F.sha2(F.array_join("hit_items", ",").cast("binary"), 256)
    return found.select("doc_id", F.col("hit_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), items.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(_read(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _read(spark, sf_dir, "pages").select("page_id", "url", url_filter.sample_time("page_id").alias("fetched"))
    judged = url_filter.judge(captures, url_filter.sample_list(captures))
    return judged.withColumn("kept", F.col("url_action") != "block")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


#: Tokens beyond which a document is over the limit.
TOKEN_LIMIT = 1024


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), budget=TOKEN_LIMIT)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = periodic.find_runs(docs.select("doc_id", periodic.with_planted_run(F.col("doc_id"), F.col("text")).alias("text")))
    best = periodic.longest(F.col("runs"))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise("")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    exponent = F.floor(F.col("best.length") * 1000 / F.col("best.period"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op1_bpe": op1_bpe, "op2_sharding": op2_sharding, "op3_langid": op3_langid, "op4_toxicity": op4_toxicity, "op5_vectors": op5_vectors, "op6_chat": op6_chat, "op7_decontaminate": op7_decontaminate, "op8_jaccard": op8_jaccard, "op9_html": op9_html, "op10_url_filter": op10_url_filter, "op11_hard_negatives": op11_hard_negatives, "op12_token_counts": op12_token_counts, "op13_runs": op13_runs}
ORACLES = {"op2_sharding": sharding.oracle(), "op5_vectors": vector_dedup.ORACLE, "op6_chat": chat.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op8_jaccard": jaccard.ORACLE, "op10_url_filter": url_filter.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE}
