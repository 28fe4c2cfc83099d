"""Queries of retrieval, models and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.functions import text as X
from tessera.operators import audit as A
from tessera.operators import models as M
from tessera.operators import scoring as S
from tessera.operators import similarity
from tessera.operators import stats
from tessera.operators import text_ops as O
from tessera.plans.inputs import ENV_SQL, GOLD_SQL, env
from tessera.plans.registry import Registry, table

REG = Registry()

TFIDF_SQL = """tok AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM benchmark),
tf AS (SELECT item_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY df DESC, term LIMIT 8000),
raw AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
tfidf AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM raw)"""


def _weights(s, d):
    return O.tfidf(table(s, d, "benchmark").select("item_id", "text"), "item_id", "text")


REG.add("tfidf_weights", lambda s, d: _weights(s, d).select("item_id", "term", F.round("weight", 6).alias("weight")), f"WITH {TFIDF_SQL} SELECT item_id, term, round(weight, 6) AS weight FROM tfidf")

_TOPK = f"""WITH {TFIDF_SQL}, sim AS (SELECT a.item_id AS query, b.item_id, coalesce(round(sum(x.weight * y.weight), 9), 0) AS s FROM benchmark a JOIN benchmark b ON a.item_id <> b.item_id LEFT JOIN tfidf x ON x.item_id = a.item_id LEFT JOIN tfidf y ON y.item_id = b.item_id AND y.term = x.term GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, item_id DESC) AS rank FROM sim) SELECT query, item_id, round(s, 6) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= 3"""


@REG.query("tfidf_topk_loo", _TOPK)
def tfidf_topk_loo(s, d):
    docs = table(s, d, "benchmark").select("item_id")
    return similarity.top_similar(docs, docs, "item_id", _weights(s, d), 3).select("query", "item_id", F.round("similarity", 6).alias("similarity"), "rank")


@REG.query("similar_documents", f"""WITH {TFIDF_SQL.replace("item_id", "doc_id").replace("benchmark", "documents")}, sim AS (SELECT x.doc_id AS query, y.doc_id, round(sum(x.weight * y.weight), 9) AS s FROM tfidf x JOIN tfidf y USING (term) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, doc_id DESC) AS rank FROM sim) SELECT query, doc_id, round(s, 6) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= 3 AND s > 0""")
def similar_documents(s, d):
    """The three documents most like each document, of those that share a term with it."""
    docs = table(s, d, "documents").select("doc_id", "text")
    found = similarity.top_similar(docs, docs, "doc_id", O.tfidf(docs, "doc_id", "text"), 3)
    return found.where("similarity > 0").select("query", "doc_id", F.round("similarity", 6).alias("similarity"), "rank")


_PROMPT = rf"""{_TOPK.split("SELECT query, item_id, round")[0]}, d AS (SELECT query, count(*) AS n_demos, string_agg('Example ' || rank || ':' || chr(10) || 'Description: ' || left(text, 500) || chr(10) || 'Flower colour: ' || trim(left(text, 12)) || chr(10), '' ORDER BY rank) AS examples FROM r JOIN benchmark USING (item_id) WHERE rank <= 3 GROUP BY query)
SELECT b.item_id AS query, coalesce(n_demos, 0) AS n_demos, CASE WHEN examples IS NULL THEN 'Species description:' || chr(10) || chr(10) || text ELSE 'Here are similar labelled examples:' || chr(10) || examples || chr(10) || 'Now extract the flower colour for this description:' || chr(10) || chr(10) || text END || chr(10) || chr(10) || 'What is the flower colour?' AS prompt
FROM benchmark b LEFT JOIN d ON d.query = b.item_id"""


@REG.query("fewshot_prompt", _PROMPT)
def fewshot_prompt(s, d):
    docs = table(s, d, "benchmark").select("item_id", "text", F.substring("text", 1, 12).alias("answer"))
    similar = similarity.top_similar(docs.select("item_id"), docs.select("item_id"), "item_id", _weights(s, d), 3)
    return O.fewshot_prompt(docs, similar, docs, "item_id", "text", "answer")


#: All components of a vector, and the first few for the models that are fitted again and again.
_ALL = [f"x{k}" for k in range(64)]
_FEATURES = _ALL[:6]


def _features(s, d, features=_FEATURES):
    """Vectors as columns, with a class from their label and a group."""
    e = table(s, d, "embeddings").where("label is not null and embedding is not null").select("vec_id", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("class"), F.concat(F.lit("g"), (F.col("vec_id") % 40).cast("string")).alias("grp"), *(F.get("embedding", F.lit(k)).cast("double").alias(x) for k, x in enumerate(features)))
    return e.dropna()


@REG.query("pca_loadings")
def pca_loadings(s, d):
    return M.Components(_features(s, d, _ALL), _ALL, 4).loading_table(s)


@REG.query("pca_scores")
def pca_scores(s, d):
    rows = _features(s, d, _ALL)
    return M.Components(rows, _ALL, 3).scores(rows).select("vec_id", "PC1", "PC2", "PC3")


@REG.query("pca_variance")
def pca_variance(s, d):
    return M.Components(_features(s, d, _ALL), _ALL, 4).variance_table(s)


@REG.query("probit_gibbs_summary")
def probit_gibbs_summary(s, d):
    rows = stats.standardise(env(s, d), "alt", "z").withColumns({f"is_{g.lower()}": C.onehot(F.col("color_group"), g) for g in ("WHITE", "YELLOW", "REDTYPE")})
    data = rows.select(F.lit("main").alias("variant"), "genus", "z", "is_white", "is_yellow", "is_redtype")
    manifest = M.task_manifest(s, [("main", "part")], [("WHITE", "is_white"), ("YELLOW", "is_yellow"), ("REDTYPE", "is_redtype")], [42, 123, 456])
    chains = M.fit_chains(manifest, data, "variant", lambda c: c, ["z"], "genus", 130, 30, 1)
    return stats.posterior_hpd(chains, ["color", "effect"])


_FOLDED = "f AS (SELECT p_partkey, genus, color_group, (p_partkey % 5)::INTEGER AS fold FROM env)"


def _folded(s, d):
    return env(s, d).select("p_partkey", "genus", "color_group", (F.col("p_partkey") % 5).cast("int").alias("fold"))


_PRIOR = f"""WITH {ENV_SQL}, {_FOLDED}, h AS (SELECT DISTINCT fold AS held FROM f),
g AS (SELECT held, genus, color_group, count(*) AS n, min(p_partkey) AS first FROM f JOIN h ON fold <> held GROUP BY ALL), gb AS (SELECT held, genus, color_group AS own, row_number() OVER (PARTITION BY held, genus ORDER BY n DESC, first) AS k FROM g),
e AS (SELECT held, color_group, sum(n) AS n, min(first) AS first FROM g GROUP BY ALL), eb AS (SELECT held, color_group AS every, row_number() OVER (PARTITION BY held ORDER BY n DESC, first) AS k FROM e)
SELECT p_partkey, color_group AS gold, coalesce(own, every) AS pred FROM f LEFT JOIN gb ON gb.held = fold AND gb.genus = f.genus AND gb.k = 1 LEFT JOIN eb ON eb.held = fold AND eb.k = 1"""


@REG.query("group_prior_cv", _PRIOR)
def group_prior_cv(s, d):
    return M.group_prior(_folded(s, d), "genus", "color_group", "fold", "p_partkey").select("p_partkey", F.col("color_group").alias("gold"), "pred")


@REG.query("majority_cv", f"WITH {ENV_SQL}, {_FOLDED}, h AS (SELECT DISTINCT fold AS held FROM f), c AS (SELECT held, color_group, count(*) AS n FROM f JOIN h ON fold <> held GROUP BY ALL), b AS (SELECT held, color_group AS pred, row_number() OVER (PARTITION BY held ORDER BY n DESC, color_group) AS k FROM c) SELECT p_partkey, pred FROM f JOIN b ON held = fold AND k = 1")
def majority_cv(s, d):
    return M.majority(_folded(s, d), "color_group", "fold").select("p_partkey", "pred")


def _cv(name):
    def run(s, d):
        rows = M.stratified_folds(_features(s, d), "vec_id", "class", 3)
        out = M.cross_validate(rows, _FEATURES, "class", "fold", name, k=3, trees=20)
        cells = S.cells(out.withColumn("model", F.lit(name)), ["model"], gold="class")
        domain = ("c0", "c1", "c2")
        return S.accuracy(cells, ["model"]).join(S.macro_f1(cells, ["model"], domain), "model").join(S.balanced_accuracy(cells, ["model"], domain), "model")

    return run


REG.add("logreg_cv", _cv("logistic"))
REG.add("rf_cv", _cv("forest"))


@REG.query(
    "grouped_folds",
    """WITH e AS (SELECT 'c' || (label % 3) AS class, 'g' || (vec_id % 40) AS grp FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding[1:64], lambda x: x IS NOT NULL AND NOT isnan(x))) = 64),
c AS (SELECT grp, class, count(*) AS n FROM e GROUP BY ALL), l AS (SELECT grp, sum(n) AS size, arg_max(class, (n, -substr(class, 2)::INTEGER)) AS lead FROM c GROUP BY 1),
p AS (SELECT grp, size, (row_number() OVER (PARTITION BY lead ORDER BY size DESC, grp) - 1) % 10 AS place FROM l)
SELECT CASE WHEN place < 5 THEN place ELSE 9 - place END::INTEGER AS fold, sum(size)::BIGINT AS n, count(*) AS groups FROM p GROUP BY 1""",
)
def grouped_folds(s, d):
    """Rows and groups of each fold; a group is in one fold."""
    f = M.grouped_folds(_features(s, d, _ALL), "grp", "class", 5)
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("groups"))


@REG.query(
    "stratified_group_folds",
    """WITH RECURSIVE o AS (SELECT o_custkey AS grp, o_orderpriority AS class FROM orders),
cl AS (SELECT class, row_number() OVER (ORDER BY class) AS c FROM (SELECT DISTINCT class FROM o)),
v AS (SELECT grp, list(coalesce(n, 0)::DOUBLE ORDER BY c) AS v, sum(n)::BIGINT AS size FROM (SELECT DISTINCT grp FROM o) CROSS JOIN cl LEFT JOIN (SELECT grp, class, count(*) AS n FROM o GROUP BY ALL) USING (grp, class) GROUP BY grp),
m AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY grp) - 1 AS k, count(*) OVER (PARTITION BY v) AS many FROM v),
dealt AS (SELECT grp, k % 5 AS fold FROM m WHERE k < many - many % 5),
l AS (SELECT grp, v, size, row_number() OVER (ORDER BY size DESC, grp) AS i FROM m WHERE k >= many - many % 5),
t AS (SELECT list(w ORDER BY c) AS w FROM (SELECT c, 1 / greatest(sum(v[c]), 1) ** 2 AS w FROM l, cl GROUP BY c)),
z AS (SELECT w, list_transform(w, lambda x: 0::DOUBLE) AS zero FROM t),
s AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS grp, -1 AS fold, [zero, zero, zero, zero, zero] AS held, [0, 0, 0, 0, 0]::DOUBLE[] AS filled, w FROM z
UNION ALL SELECT i, grp, fold, list_transform(held, lambda h, f: CASE WHEN f = fold + 1 THEN list_transform(h, lambda x, c: x + v[c]) ELSE h END), list_transform(filled, lambda r, f: CASE WHEN f = fold + 1 THEN r + size ELSE r END), w
  FROM (SELECT l.i, l.grp, l.v, l.size, held, filled, w, list_sort(list_transform(held, lambda h, f: {'cost': round(list_sum(list_transform(h, lambda x, c: x * (l.v[c] * w[c]))), 12), 'filled': filled[f], 'fold': f - 1}))[1].fold AS fold FROM s JOIN l ON l.i = s.i + 1)),
f AS (SELECT grp, fold FROM dealt UNION ALL SELECT grp, fold FROM s WHERE i > 0)
SELECT grp, fold::INTEGER AS fold FROM f""",
)
def stratified_group_folds(s, d):
    """The fold of each customer, such that order priorities are spread evenly."""
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("class"))
    return M.stratified_group_folds(orders, "grp", "class", 5).select("grp", "fold").distinct()


@REG.query("perm_importance")
def perm_importance(s, d):
    return M.permutation_importance(_features(s, d), _FEATURES[:3], "class", "vec_id", "logistic", repeats=3)


def _audit(s, d):
    audit = A.Audit(s)
    part = table(s, d, "part")
    counts = part.select(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("k"))
    audit.equal("parts", "sizes are positive", part.agg(F.min("p_size").alias("m")), "m", 1, 0)
    audit.same("regions", "first region", table(s, d, "region").agg(F.min("r_name").alias("m")), "m", "AFRICA")
    audit.equal("parts", "keys are unique", counts.select((F.col("n") - F.col("k")).alias("gap")), "gap", 0, 0)
    audit.none("labels", "one label a document", A.repeated(table(s, d, "labels"), "doc_id"))
    audit.none("labels", "known colours only", A.leaked(env(s, d), "color_group"))
    audit.pending("chains", "36 chain files")
    return audit.table()


_AUDIT_SQL = f"""WITH {ENV_SQL}, c AS (SELECT 'parts' AS section, 'sizes are positive' AS name, min(p_size)::VARCHAR AS got, '1' AS want, 'tolerance 0' AS detail, CASE WHEN min(p_size) = 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM part
UNION ALL SELECT 'regions', 'first region', min(r_name), 'AFRICA', 'equal', CASE WHEN min(r_name) = 'AFRICA' THEN 'PASS' ELSE 'FAIL' END FROM region
UNION ALL SELECT 'parts', 'keys are unique', (count(*) - count(DISTINCT p_partkey))::VARCHAR, '0', 'tolerance 0', CASE WHEN count(*) = count(DISTINCT p_partkey) THEN 'PASS' ELSE 'FAIL' END FROM part
UNION ALL SELECT 'labels', 'one label a document', count(*)::VARCHAR, '0', 'violations', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'labels', 'known colours only', count(*)::VARCHAR, '0', 'violations', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM env WHERE color_group NOT IN ('WHITE', 'YELLOW', 'REDTYPE')
UNION ALL SELECT 'chains', '36 chain files', NULL, '', 'input is absent', 'PEND')"""


@REG.query("audit_checks", f"{_AUDIT_SQL} SELECT * FROM c")
def audit_checks(s, d):
    return _audit(s, d)


@REG.query("audit_summary", f"{_AUDIT_SQL} SELECT status, count(*) AS n FROM c GROUP BY 1")
def audit_summary(s, d):
    return A.summary(_audit(s, d))


@REG.query("invariant_violations", f"WITH {GOLD_SQL} SELECT 'labels unique' AS invariant, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'funnel falls', (SELECT count(*) FROM (SELECT count(*) AS a, count(*) FILTER (n_chars >= 300) AS b, count(*) FILTER (n_chars >= 3000) AS c FROM documents) WHERE a < b OR b < c) UNION ALL SELECT 'texts kept', 0 UNION ALL SELECT 'interval order', (SELECT count(*) FROM events WHERE value - 1 > value OR value > value + 1)")
def invariant_violations(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars", "source")
    funnel = docs.agg(F.count("*").alias("a"), F.count_if(F.col("n_chars") >= 300).alias("b"), F.count_if(F.col("n_chars") >= 3000).alias("c"))
    spread = table(s, d, "events").select((F.col("value") - 1).alias("lo"), "value", (F.col("value") + 1).alias("hi"))
    tests = {"labels unique": A.repeated(table(s, d, "labels"), "doc_id"), "funnel falls": A.not_falling(funnel, ["a", "b", "c"]), "texts kept": A.overwritten(docs, docs, "doc_id", "source"), "interval order": A.disordered(spread, "lo", "value", "hi")}
    out = None
    for name, bad in tests.items():
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("invariant"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@REG.query("parsed_numbers", r"SELECT s_suppkey, TRY_CAST(nullif(regexp_extract(s_name, '(\d+)', 1), '') AS DOUBLE) AS number FROM supplier")
def parsed_numbers(s, d):
    return table(s, d, "supplier").select("s_suppkey", X.number_in(F.col("s_name"), r"(\d+)").alias("number"))


