"""Queries of scores, agreement and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.operators import scoring as S
from tessera.operators import joins as J
from tessera.operators import stats
from tessera.plans.inputs import GOLD_SQL, phrases, scored
from tessera.plans.registry import Registry, table
from tessera.plans.text import CLASS_SQL, V2_SQL, _V1

REG = Registry()
_CELLS = f"WITH {GOLD_SQL}, cells AS (SELECT model, gold, pred, count(*) AS n FROM scored GROUP BY ALL)"
_GRID = "SELECT m.model, g.c AS gold, p.c AS pred, coalesce(n, 0) AS n FROM (SELECT DISTINCT model FROM cells) m, (VALUES ('WHITE'), ('YELLOW'), ('REDTYPE'), ('UNKNOWN'), ('OTHER')) g(c), (VALUES ('WHITE'), ('YELLOW'), ('REDTYPE'), ('UNKNOWN'), ('OTHER')) p(c) LEFT JOIN cells c ON c.model = m.model AND c.gold = g.c AND c.pred = p.c"
_PRF = f"""{_CELLS}, grid AS ({_GRID}),
sums AS (SELECT model, c AS class, sum(tp) AS tp, sum(s) AS support, sum(k) AS called FROM (SELECT model, gold AS c, CASE WHEN gold = pred THEN n ELSE 0 END AS tp, n AS s, 0 AS k FROM grid UNION ALL SELECT model, pred, 0, 0, n FROM grid) GROUP BY ALL),
prf AS (SELECT model, class, support::BIGINT AS support, CASE WHEN called = 0 THEN 0.0 ELSE tp / called END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM sums),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM prf)"""


def _cells(s, d):
    return S.cells(scored(s, d), ["model"])


REG.add("accuracy_by_model", lambda s, d: S.accuracy(_cells(s, d), ["model"]), f"{_CELLS} SELECT model, sum(n)::BIGINT AS n, sum(n) FILTER (gold = pred) / sum(n) AS accuracy FROM cells GROUP BY 1")
REG.add("prf_by_class", lambda s, d: S.by_class(_cells(s, d), ["model"]), f"{_PRF} SELECT * FROM f")
REG.add("macro_f1", lambda s, d: S.macro_f1(_cells(s, d), ["model"]), f"{_PRF} SELECT model, avg(f1) AS macro_f1 FROM f WHERE support > 0 GROUP BY 1")
REG.add("balanced_accuracy", lambda s, d: S.balanced_accuracy(_cells(s, d), ["model"]), f"{_PRF} SELECT model, avg(recall) AS balanced_accuracy FROM f WHERE support > 0 GROUP BY 1")
REG.add("confusion_matrix", lambda s, d: S.confusion(_cells(s, d), ["model"]), f"{_CELLS} {_GRID}")
REG.add("confusion_row_share", lambda s, d: S.row_share(_cells(s, d), ["model"]), f"{_CELLS}, grid AS ({_GRID}) SELECT model, gold, pred, CASE WHEN t = 0 THEN 0.0 ELSE n / t END AS share FROM (SELECT *, sum(n) OVER (PARTITION BY model, gold) AS t FROM grid)")
_KAPPA = f"""{_CELLS}, m AS (SELECT model, c, sum(g) AS g, sum(p) AS p FROM (SELECT model, gold AS c, n AS g, 0 AS p FROM cells UNION ALL SELECT model, pred, 0, n FROM cells) GROUP BY ALL),
e AS (SELECT model, sum(g * p) / (sum(g) * sum(g))::DOUBLE AS pe FROM m GROUP BY 1), a AS (SELECT model, sum(n) FILTER (gold = pred) / sum(n) AS po FROM cells GROUP BY 1)
SELECT model, CASE WHEN pe = 1 THEN 0.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM a JOIN e USING (model)"""
REG.add("cohen_kappa", lambda s, d: S.kappa(_cells(s, d), ["model"]), _KAPPA)


@REG.query("intervention_delta", f"WITH {V2_SQL}, b AS (SELECT id, {CLASS_SQL} AS c2 FROM v2), a AS (SELECT id, {CLASS_SQL} AS c1 FROM (SELECT id, {_V1} AS fine FROM (SELECT *, lower(txt) AS t FROM phrases))), g AS (SELECT id, c1, c2, CASE WHEN length(txt) % 2 = 0 THEN c1 ELSE c2 END AS gold FROM a JOIN b USING (id) JOIN phrases USING (id)) SELECT count(*) AS n, round(avg((c1 = gold)::INTEGER), 4) AS acc_v1, round(avg((c2 = gold)::INTEGER), 4) AS acc_v2, round(avg((c2 = gold)::INTEGER) - avg((c1 = gold)::INTEGER), 4) AS delta_acc FROM g")
def intervention_delta(s, d):
    c1, c2 = C.to_class(C.categorise_v1(F.col("txt"))), C.to_class(C.categorise_v2(F.col("txt")))
    rows = phrases(s, d).select(c1.alias("c1"), c2.alias("c2"), F.when(F.length("txt") % 2 == 0, c1).otherwise(c2).alias("gold"))
    a, b = F.avg((F.col("c1") == F.col("gold")).cast("int")), F.avg((F.col("c2") == F.col("gold")).cast("int"))
    return rows.agg(F.count("*").alias("n"), F.round(a, 4).alias("acc_v1"), F.round(b, 4).alias("acc_v2"), F.round(b - a, 4).alias("delta_acc"))


@REG.query("abstention_scores", f"WITH {V2_SQL}, a AS (SELECT CASE WHEN lower(trim(txt)) = 'uncertain' THEN 'UNKNOWN' ELSE {CLASS_SQL} END AS class, (lower(trim(txt)) = 'uncertain')::INTEGER AS u FROM v2) SELECT class, count(*) AS n, sum(u)::BIGINT AS n_uncertain FROM a GROUP BY 1")
def abstention_scores(s, d):
    rows = phrases(s, d).select(C.with_abstention(F.col("txt")).alias("class"), (F.lower(F.trim("txt")) == "uncertain").cast("int").alias("u"))
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.sum("u").alias("n_uncertain"))


@REG.query("model_disagreement", f"WITH {GOLD_SQL} SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, count(*) FILTER (a.pred <> b.pred) AS differ FROM scored a JOIN scored b ON a.doc_id = b.doc_id AND a.model < b.model GROUP BY ALL")
def model_disagreement(s, d):
    a = scored(s, d).select("doc_id", F.col("model").alias("model_a"), F.col("pred").alias("pa"))
    b = scored(s, d).select("doc_id", F.col("model").alias("model_b"), F.col("pred").alias("pb"))
    met = a.join(b, "doc_id").where("model_a < model_b")
    return met.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.count_if(F.col("pa") != F.col("pb")).alias("differ"))


@REG.query("error_taxonomy_crosstab", f"WITH {GOLD_SQL} SELECT model, CASE WHEN gold = 'UNKNOWN' THEN 'FALSE_POSITIVE' WHEN pred = 'UNKNOWN' THEN 'FALSE_NEGATIVE' ELSE 'OTHER_MISMATCH' END AS error_class, count(*) AS n FROM scored WHERE gold <> pred GROUP BY ALL")
def error_taxonomy_crosstab(s, d):
    from tessera.operators.text_ops import error_class

    e = F.lit("")
    rows = scored(s, d).where("gold <> pred").select("model", error_class(e, e, e, e, F.col("gold"), F.col("pred"), F.lit(False)).alias("error_class"))
    return rows.groupBy("model", "error_class").agg(F.count("*").alias("n"))


_WIDE = f"WITH {GOLD_SQL}, w AS (SELECT doc_id, max(gold) AS gold, max(pred) FILTER (model = 'length') AS a, max(pred) FILTER (model = 'source') AS b, coalesce(max(pred) FILTER (model = 'mixed' AND doc_id % 10 <> 3), 'MISSING') AS c FROM scored GROUP BY 1)"


def _wide(s, d):
    rows = scored(s, d)
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("pred")))
    mixed = F.max(F.when((F.col("model") == "mixed") & (F.col("doc_id") % 10 != 3), F.col("pred")))
    return rows.groupBy("doc_id").agg(F.max("gold").alias("gold"), pick("length").alias("a"), pick("source").alias("b"), F.coalesce(mixed, F.lit("MISSING")).alias("c"))


_KNOWN3 = " AND ".join(f"{x} IN ('WHITE', 'YELLOW', 'REDTYPE')" for x in "abc")


@REG.query("agreement_funnel", f"{_WIDE}, f AS (SELECT count(*) AS n, count(*) FILTER (c <> 'MISSING') AS covered, count(*) FILTER ({_KNOWN3}) AS known, count(*) FILTER ({_KNOWN3} AND a = b AND b = c) AS agree FROM w) SELECT *, known - agree AS disagree, round(agree / known, 4) AS agree_of_known, round(agree / covered, 4) AS agree_of_covered FROM f")
def agreement_funnel(s, d):
    return S.agreement_funnel(_wide(s, d), ["a", "b", "c"], ("WHITE", "YELLOW", "REDTYPE"))


@REG.query("high_confidence_set", f"{_WIDE} SELECT doc_id, a AS label, (a = 'WHITE')::INTEGER AS is_white, (a = 'YELLOW')::INTEGER AS is_yellow, (a = 'REDTYPE')::INTEGER AS is_redtype FROM w WHERE {_KNOWN3} AND a = b AND b = c")
def high_confidence_set(s, d):
    known = lambda x: F.col(x).isin("WHITE", "YELLOW", "REDTYPE")
    kept = _wide(s, d).where(known("a") & known("b") & known("c") & (F.col("a") == F.col("b")) & (F.col("b") == F.col("c")))
    return kept.select("doc_id", F.col("a").alias("label"), *(C.onehot(F.col("a"), g).alias(f"is_{g.lower()}") for g in ("WHITE", "YELLOW", "REDTYPE")))


@REG.query("disagreement_rows", f"WITH {GOLD_SQL} SELECT doc_id, model, gold, pred, left(n_chars::VARCHAR, 3) AS n_chars FROM scored WHERE gold <> pred")
def disagreement_rows(s, d):
    return S.disagreements(scored(s, d), {"n_chars": 3}).select("doc_id", "model", "gold", "pred", "n_chars")


@REG.query("label_variant_flip", f"{_WIDE} SELECT a AS label_a, b AS label_b, count(*) AS n FROM w GROUP BY ALL")
def label_variant_flip(s, d):
    return _wide(s, d).groupBy(F.col("a").alias("label_a"), F.col("b").alias("label_b")).agg(F.count("*").alias("n"))


_SUBSETS = """WITH e AS (SELECT event_type || '~' || (user_id % 4)::VARCHAR AS effect, CASE WHEN event_id % 2 = 0 THEN 'common' ELSE 'high' END AS subset, value - 50 AS x FROM events),
t AS (SELECT effect, subset, avg(x) AS mean, avg(x) - 1.96 * stddev_samp(x) / sqrt(count(*)) AS lower, avg(x) + 1.96 * stddev_samp(x) / sqrt(count(*)) AS upper FROM e GROUP BY ALL),
w AS (SELECT effect, max(mean) FILTER (subset = 'common') AS common_mean, max(lower) FILTER (subset = 'common') AS common_lower, max(upper) FILTER (subset = 'common') AS common_upper, max(mean) FILTER (subset = 'high') AS high_mean, max(lower) FILTER (subset = 'high') AS high_lower, max(upper) FILTER (subset = 'high') AS high_upper FROM t GROUP BY 1)"""


@REG.query("robustness_designation", f"{_SUBSETS} SELECT *, CASE WHEN sign(common_mean) = sign(high_mean) AND (common_lower > 0 OR common_upper < 0) AND (high_lower > 0 OR high_upper < 0) THEN 'robust' WHEN sign(common_mean) = sign(high_mean) THEN 'same_direction_interval_changes' ELSE 'label-sensitive' END AS designation FROM w")
def robustness_designation(s, d):
    e = table(s, d, "events").select(F.concat("event_type", F.lit("~"), (F.col("user_id") % 4).cast("string")).alias("effect"), F.when(F.col("event_id") % 2 == 0, "common").otherwise("high").alias("subset"), (F.col("value") - 50).alias("x"))
    half = 1.96 * F.stddev_samp("x") / F.sqrt(F.count("*"))
    t = e.groupBy("effect", "subset").agg(F.avg("x").alias("mean"), (F.avg("x") - half).alias("lower"), (F.avg("x") + half).alias("upper"))
    w = J.pair_wide(t, ["effect"], "subset", ("common", "high"), ["mean", "lower", "upper"])
    return w.withColumn("designation", S.designation(*(F.col(f"{p}_{c}") for p in ("common", "high") for c in ("lower", "upper", "mean"))))


@REG.query("retention_funnel", "WITH s AS (SELECT 1 AS stage, count(*) AS n FROM documents UNION ALL SELECT 2, count(*) FROM documents WHERE n_chars >= 300 UNION ALL SELECT 3, count(*) FROM documents WHERE n_chars >= 300 AND lang = 'en' UNION ALL SELECT 4, count(*) FROM documents WHERE n_chars >= 300 AND lang = 'en' AND source <> 'src0') SELECT stage, n, round(100 * n / first_value(n) OVER (ORDER BY stage), 4) AS of_first, round(100 * n / lag(n) OVER (ORDER BY stage), 4) AS of_previous FROM s")
def retention_funnel(s, d):
    docs = table(s, d, "documents").select("n_chars", "lang", "source")
    long = F.col("n_chars") >= 300
    tests = [F.lit(True), long, long & (F.col("lang") == "en"), long & (F.col("lang") == "en") & (F.col("source") != "src0")]
    one = docs.agg(*(F.count_if(t).alias(f"s{k}") for k, t in enumerate(tests)))
    stages = one.select(F.inline(F.array(*(F.struct(F.lit(k + 1).alias("stage"), F.col(f"s{k}").alias("n")) for k in range(4)))))
    return S.retention(stages, "stage", "n")


@REG.query("bootstrap_ci")
def bootstrap_ci(s, d):
    return S.metric_bootstrap(_cells(s, d), ["model"], "macro_f1", 2000, 42)


@REG.query("effect_concordance", "WITH v AS (SELECT event_type AS effect, (user_id % 20)::INTEGER AS variable, CASE event_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'b' ELSE 'c' END AS variant, avg(value) AS m FROM events GROUP BY ALL) SELECT o.variant, count(*) AS n, corr(o.m, r.m) AS r, max(abs(o.m - r.m)) AS max_deviation FROM v o JOIN v r ON o.effect = r.effect AND o.variable = r.variable AND r.variant = 'original' WHERE o.variant <> 'original' GROUP BY 1")
def effect_concordance(s, d):
    k = F.col("event_id") % 3
    v = table(s, d, "events").groupBy(F.col("event_type").alias("effect"), (F.col("user_id") % 20).cast("int").alias("variable"), F.when(k == 0, "original").when(k == 1, "b").otherwise("c").alias("variant")).agg(F.avg("value").alias("m"))
    return stats.concordance(v, ["effect", "variable"], "variant", "original", "m")


