"""Queries whose keys hold nulls: the language of a document is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import reshape as R
from tessera.operators import stats
from tessera.operators import verbs as V
from tessera.plans.registry import Registry, table

REG = Registry()
_COUNTS = "counts AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)"
_CHANGES = "a AS (SELECT lang, count(*) AS n, NULL::VARCHAR AS note FROM documents GROUP BY 1), b AS (SELECT lang, min(doc_id) AS n, 'least' AS note FROM documents WHERE lang IS NULL OR lang > 'de' GROUP BY 1 UNION ALL VALUES ('zz', -1::BIGINT, 'new'))"


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")


def _changes(s, d):
    docs = _docs(s, d)
    a = docs.groupBy("lang").agg(F.count("*").alias("n")).withColumn("note", F.lit(None).cast("string"))
    b = docs.where("lang is null or lang > 'de'").groupBy("lang").agg(F.min("doc_id").alias("n")).withColumn("note", F.lit("least"))
    return a, b.unionByName(s.createDataFrame([("zz", -1, "new")], "lang string, n long, note string"))


REG.add("null_group_ids", lambda s, d: V.group_ids(_docs(s, d).select("doc_id", "lang"), "lang"), "SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang NULLS LAST)::INTEGER AS group_id FROM documents")


@REG.query("null_zscore", "SELECT doc_id, round((n_chars - avg(n_chars) OVER w) / stddev_samp(n_chars) OVER w, 6) AS z FROM documents WINDOW w AS (PARTITION BY lang)")
def null_zscore(s, d):
    return stats.standardise(_docs(s, d), "n_chars", "z", ("lang",)).select("doc_id", F.round("z", 6).alias("z"))


@REG.query("null_complete", f"WITH {_COUNTS} SELECT l.lang, r.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM counts) l CROSS JOIN (SELECT DISTINCT source FROM counts) r LEFT JOIN counts c ON l.lang IS NOT DISTINCT FROM c.lang AND r.source IS NOT DISTINCT FROM c.source")
def null_complete(s, d):
    return R.complete(_docs(s, d).groupBy("lang", "source").agg(F.count("*").alias("n")), "lang", "source", fill={"n": 0})


@REG.query("null_nest_join", "SELECT x.lang, coalesce(len(ids), 0)::INTEGER AS n, ids[1] AS least FROM (SELECT DISTINCT lang FROM documents) x LEFT JOIN (SELECT lang, list(doc_id ORDER BY doc_id) AS ids FROM documents WHERE doc_id % 7 = 0 GROUP BY 1) y ON x.lang IS NOT DISTINCT FROM y.lang")
def null_nest_join(s, d):
    docs = _docs(s, d)
    nested = J.nest_join(docs.select("lang").distinct(), docs.where("doc_id % 7 = 0").select("lang", "doc_id"), "lang")
    return nested.select("lang", F.size("matches").alias("n"), F.try_element_at("matches", F.lit(1))["doc_id"].alias("least"))


@REG.query("null_separate_longer", "SELECT doc_id, unnest(CASE WHEN lang IS NULL THEN [NULL] ELSE string_split(lang || '-' || source, '-') END) AS part FROM documents")
def null_separate_longer(s, d):
    return R.separate_longer(_docs(s, d).select("doc_id", F.concat("lang", F.lit("-"), "source").alias("part")), "part", "-")


REG.add("null_rows_update", lambda s, d: J.rows_update(*_changes(s, d), ["lang"], "ignore"), f"WITH {_CHANGES} SELECT a.lang, CASE WHEN b.note IS NULL THEN a.n ELSE b.n END AS n, coalesce(b.note, a.note) AS note FROM a LEFT JOIN b ON a.lang IS NOT DISTINCT FROM b.lang")
REG.add("null_rows_patch", lambda s, d: J.rows_patch(*_changes(s, d), ["lang"], "ignore"), f"WITH {_CHANGES} SELECT a.lang, a.n, coalesce(a.note, b.note) AS note FROM a LEFT JOIN b ON a.lang IS NOT DISTINCT FROM b.lang")
REG.add("null_rows_upsert", lambda s, d: J.rows_upsert(*_changes(s, d), ["lang"]), f"WITH {_CHANGES} SELECT a.lang, coalesce(b.n, a.n) AS n, coalesce(b.note, a.note) AS note FROM a LEFT JOIN b ON a.lang IS NOT DISTINCT FROM b.lang UNION ALL SELECT * FROM b WHERE lang = 'zz'")
REG.add("null_rows_insert", lambda s, d: J.rows_insert(*_changes(s, d), ["lang"], "ignore"), f"WITH {_CHANGES} SELECT * FROM a UNION ALL SELECT * FROM b WHERE lang = 'zz'")
REG.add("null_rows_delete", lambda s, d: J.rows_delete(*_changes(s, d), ["lang"], "ignore"), f"WITH {_CHANGES} SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.lang IS NOT DISTINCT FROM b.lang)")


def _closest(s, d, order):
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 700).alias("at"), "o_orderkey")
    events = table(s, d, "events").select("event_id", "user_id", (F.col("event_id") % 700).alias("at"))
    return J.asof_join(events, orders, ["user_id"], "at", "at", ["o_orderkey"], "o_orderkey", order).select("event_id", "o_orderkey")


for _name, _order, _side in (("closest_before", ">", "max"), ("closest_after", "<", "min"), ("closest_at_or_after", "<=", "min")):
    REG.add(
        _name,
        lambda s, d, order=_order: _closest(s, d, order),
        f"SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, event_id % 700 AS at FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderkey % 700 AS at, {_side}(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.at {_order} o.at",
    )
