"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import colour as C
from tessera.functions import text as X
from tessera.operators import locator as L
from tessera.operators import text_ops as O
from tessera.operators import verbs as V
from tessera.plans.inputs import PHRASE_SQL, phrases
from tessera.plans.registry import Registry, table

REG = Registry()

# SQL twins of the categorisers.
_BLANK = r"regexp_full_match(txt, '\s*')"
_TAIL = "WHEN contains(t, 'white') OR contains(t, 'whitish') THEN 'WHITE' WHEN contains(t, 'yellow') OR contains(t, 'golden') THEN 'YELLOW' WHEN contains(t, 'pink') THEN 'PINK' WHEN contains(t, 'red') THEN 'RED' WHEN contains(t, 'purpl') AND (contains(t, 'purple') OR contains(t, 'purplish')) OR contains(t, 'violet') OR contains(t, 'blue') THEN 'PURPLE/BLUE' WHEN contains(t, 'greenish') THEN 'GREENISH'"
_V1 = f"CASE WHEN {_BLANK} THEN 'UNKNOWN' {_TAIL} WHEN contains(t, 'no flower colour') THEN 'UNKNOWN' ELSE 'OTHER' END"
_V1X = f"CASE WHEN {_BLANK} OR contains(t, 'no flower colour') OR contains(t, 'uncertain') THEN 'UNKNOWN' {_TAIL} ELSE 'OTHER' END"
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\b(?:greenish|yellowish|creamy|cream|greyish|grayish|bluish|pinkish|purplish|reddish|pale|dull|bright|dirty)[\s\-]+white\b', 'white', 'g'), '\b(?:greenish|creamy|cream|pale|dull|bright|dirty)[\s\-]+yellow\b', 'yellow', 'g'), '\bcream(?:\-?coloured|\-?colored)?\b', 'yellow', 'g'), '\borange\b', 'yellow', 'g')"
_TOKEN = r"regexp_extract(n, 'whitish|white|yellowish|yellow|golden|pinkish|pink|scarlet|crimson|reddish|\bred\b|purplish|purple|violet|bluish|\bblue\b|orange|greenish|\bgreen\b|cream', 0)"
_V2 = f"CASE WHEN {_BLANK} OR contains(t, 'no flower colour') THEN 'UNKNOWN' WHEN k IN ('whitish', 'white') THEN 'WHITE' WHEN k IN ('yellowish', 'yellow', 'golden') THEN 'YELLOW' WHEN k IN ('pinkish', 'pink') THEN 'PINK' WHEN k IN ('scarlet', 'crimson', 'reddish', 'red') THEN 'RED' WHEN k IN ('purplish', 'purple', 'violet', 'bluish', 'blue') THEN 'PURPLE/BLUE' WHEN k IN ('greenish', 'green') THEN 'GREENISH' ELSE 'OTHER' END"
V2_SQL = f"{PHRASE_SQL}, v2 AS (SELECT id, txt, {_V2} AS fine FROM (SELECT *, {_TOKEN} AS k FROM (SELECT *, {_NORMAL} AS n FROM (SELECT *, lower(txt) AS t FROM phrases))))"
CLASS_SQL = "CASE WHEN fine IN ('WHITE', 'YELLOW') THEN fine WHEN fine IN ('RED', 'PINK', 'PURPLE/BLUE') THEN 'REDTYPE' WHEN fine = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'OTHER' END"

REG.add("categorise_v1", lambda s, d: phrases(s, d).select("id", C.categorise_v1(F.col("txt")).alias("fine")), f"WITH {PHRASE_SQL} SELECT id, {_V1} AS fine FROM (SELECT *, lower(txt) AS t FROM phrases)")
REG.add("categorise_v1x", lambda s, d: phrases(s, d).select("id", C.categorise_v1x(F.col("txt")).alias("fine")), f"WITH {PHRASE_SQL} SELECT id, {_V1X} AS fine FROM (SELECT *, lower(txt) AS t FROM phrases)")
REG.add("categorise_v2", lambda s, d: phrases(s, d).select("id", C.categorise_v2(F.col("txt")).alias("fine")), f"WITH {V2_SQL} SELECT id, fine FROM v2")


@REG.query("class_counts", f"WITH {V2_SQL} SELECT {CLASS_SQL} AS class, count(*) AS n FROM v2 GROUP BY 1")
def class_counts(s, d):
    return V.count(phrases(s, d).select(C.to_class(C.categorise_v2(F.col("txt"))).alias("class")), "class", sort=True)


@REG.query("colour_category_counts", f"WITH {V2_SQL} SELECT fine AS color_category, count(*) AS n FROM v2 GROUP BY 1")
def colour_category_counts(s, d):
    return V.count(phrases(s, d).select(C.categorise_v2(F.col("txt")).alias("color_category")), "color_category", sort=True)


@REG.query("top_phrases", "SELECT p_name AS phrase, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, phrase LIMIT 50")
def top_phrases(s, d):
    counts = V.count(table(s, d, "part").select(F.col("p_name").alias("phrase")), "phrase")
    return counts.orderBy(F.desc("n"), "phrase").limit(50)


_KEYWORDS = "whitish|white|yellowish|yellow|golden|pinkish|pink|purplish|purple|violet|bluish|blue|reddish|scarlet|crimson|red|orange|greenish|green|cream"


@REG.query(
    "keyword_extract",
    rf"""WITH {PHRASE_SQL}, s AS (SELECT id, list_filter(regexp_split_to_array(lower(txt), '[.;\n]'), lambda x: regexp_matches(x, '\b(flowers?|petals?|corolla|perianth|tepals?|florets?|blossoms?)\b') AND regexp_matches(x, '\b({_KEYWORDS})\b'))[1] AS x FROM phrases),
k AS (SELECT id, regexp_extract(x, '\b({_KEYWORDS})\b', 1) AS w FROM s)
SELECT id, CASE WHEN w IS NULL OR w = '' THEN 'no flower colour mentioned' ELSE 'flowers ' || CASE w WHEN 'whitish' THEN 'white' WHEN 'yellowish' THEN 'yellow' WHEN 'golden' THEN 'yellow' WHEN 'pinkish' THEN 'pink' WHEN 'purplish' THEN 'purple' WHEN 'violet' THEN 'purple' WHEN 'bluish' THEN 'blue' WHEN 'reddish' THEN 'red' WHEN 'scarlet' THEN 'red' WHEN 'crimson' THEN 'red' WHEN 'green' THEN 'greenish' ELSE w END END AS said FROM k""",
)
def keyword_extract(s, d):
    return phrases(s, d).select("id", C.keyword_extract(F.col("txt")).alias("said"))


@REG.query("token_counts", "SELECT w AS token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) GROUP BY 1")
def token_counts(s, d):
    tok = table(s, d, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token"))
    per = tok.groupBy("token", "doc_id").agg(F.count("*").alias("m"))
    return per.groupBy("token").agg(F.sum("m").alias("n"), F.count("*").alias("docs"))


@REG.query(
    "junk_flags",
    r"""WITH n AS (SELECT p_partkey AS id, p_name AS snippet, CASE p_partkey % 5 WHEN 0 THEN '12. ' || p_name WHEN 1 THEN upper(left(p_name, 1)) || substr(p_name, 2) WHEN 2 THEN upper(left(p_name, 1)) || '. ' || p_name WHEN 3 THEN 'Shrubs, ' || p_name ELSE upper(p_name) END AS name FROM part),
p AS (SELECT id, snippet, trim(regexp_replace(name, '^\s*\d+\.?\s*', '')) AS x FROM n),
t AS (SELECT id, snippet, regexp_extract(x, '^(\S+)', 1) AS g, regexp_extract(x, '^\S+\s+(\S+)', 1) AS e FROM p)
SELECT id, concat_ws(' | ', CASE WHEN regexp_matches(lower(g), '^(shrubs?|herbs?|trees?|leaves|flowers?|stems?|fruits?|seeds?)[,.]?$') THEN 'AUTO-FLAG: species_id is not a real taxon heading (matched mid-description text) - verify the row before labelling, may need to re-check raw text'
  WHEN regexp_matches(g, '^[A-Z]\.?$') THEN 'AUTO-FLAG: abbreviated genus (''' || g || ''') - this is likely a duplicate identification-key stub, not the real species treatment; the full name may appear elsewhere in the volume'
  WHEN g <> '' AND e <> '' AND NOT regexp_matches(e, '^[a-z][a-z-]{2,}') AND NOT regexp_matches(g, '^[A-Z][a-z]{2,}$') THEN 'AUTO-FLAG: species_id looks garbled/non-taxonomic (genus token=''' || g || ''') - verify before labelling'
  WHEN g <> '' AND e <> '' AND NOT regexp_matches(e, '^[a-z][a-z-]{2,}') THEN 'AUTO-FLAG: possible genus-level header (epithet token=''' || e || ''', not lowercase) - likely describes the whole genus, not one species'
  WHEN e = '' THEN 'AUTO-FLAG: could not find a second token (epithet) - inspect species_id manually' END,
  CASE WHEN length(trim(snippet)) < 60 THEN 'AUTO-FLAG: very short description snippet - may lack real info' END) AS flags FROM t""",
)
def junk_flags(s, d):
    n = F.col("p_name")
    cap = F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 1000))
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit("12. "), n)).when(k == 1, cap).when(k == 2, F.concat(F.upper(F.substring(n, 1, 1)), F.lit(". "), n)).when(k == 3, F.concat(F.lit("Shrubs, "), n)).otherwise(F.upper(n))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), X.junk_flags(name, n).alias("flags"))


#: Texts of part names with each sign of noise in some; a fruit word and what is near it make the whole text.
_NOISY = "CASE p_partkey % 6 WHEN 0 THEN 'see 1.0' || p_name WHEN 1 THEN repeat('Text of a treatment. ', 3) || 'Cultivated in hills. DIPTEROCARPACEAE ' || repeat('More. ', p_size) WHEN 2 THEN 'berries ' || p_name WHEN 3 THEN p_name || ' fruit and flower' ELSE p_name END"


@REG.query(
    "noise_signs",
    rf"""WITH t AS (SELECT {_NOISY} AS text, split_part(p_name, ' ', 1) AS epithet, lpad(p_partkey::VARCHAR, 9, '0') AS name FROM part), p AS (SELECT *, regexp_extract(text, '{O.FAMILY}', 1) AS family FROM t), q AS (SELECT *, strpos(text, family) - 1 AS place FROM p),
f AS (SELECT name, 'zero_O_boundary' AS signature, regexp_matches(text, '\d+\.0[a-z]{{3,}}') AS hit FROM q UNION ALL SELECT name, 'truncated_epithet_suspect', regexp_matches(epithet, '^[a-z]{{3,8}}$') AND NOT regexp_matches(epithet, '[aeious]$') FROM q
  UNION ALL SELECT name, 'cross_family_contamination', family <> '' AND place > 50 AND regexp_matches(substr(text, greatest(1, place - 79), least(80, place)), '{O.ENDING}') AND length(text) - place > 150 FROM q
  UNION ALL SELECT name, 'fruit_near_color', regexp_matches(text, '(?i){O.FRUIT}') AND regexp_matches(text, '(?i){O.ERROR_COLOURS}') AND NOT regexp_matches(text, '(?i){O.FLOWER}') FROM q),
e AS (SELECT signature, string_agg(name, '; ' ORDER BY name) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY name) AS r FROM f WHERE hit) WHERE r <= 8 GROUP BY 1)
SELECT signature, count(*) FILTER (hit) AS count, round(100.0 * count(*) FILTER (hit) / count(*), 3) AS pct, coalesce(any_value(examples), '') AS examples FROM f LEFT JOIN e USING (signature) GROUP BY 1""",
)
def noise_signs(s, d):
    """The operator's own signatures, on part names as texts and epithets."""
    rows = table(s, d, "part").select(F.expr(_NOISY).alias("text"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("epithet"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("name"))
    return O.noise_signatures(rows, "text", "epithet", "name")


_HINTS = " OR ".join(f"contains(t, '{h}')" for h in X.HINTS)
STRATUM_SQL = f"CASE WHEN fine = 'UNKNOWN' THEN 'no_mention' WHEN {_HINTS} THEN 'ambiguous' WHEN fine = 'WHITE' THEN 'clear_white' WHEN fine = 'YELLOW' THEN 'clear_yellow' WHEN fine IN ('RED', 'PINK', 'PURPLE/BLUE') THEN 'clear_redtype' END"


@REG.query("strata", f"WITH {V2_SQL} SELECT id, {STRATUM_SQL} AS stratum FROM (SELECT *, lower(txt) AS t FROM v2)")
def strata(s, d):
    return phrases(s, d).select("id", X.stratum(C.categorise_v2(F.col("txt")), F.col("txt")).alias("stratum"))


@REG.query("strata_sample", f"WITH {V2_SQL}, q AS (SELECT stratum, count(*) AS m FROM (SELECT {STRATUM_SQL} AS stratum FROM (SELECT *, lower(txt) AS t FROM v2)) GROUP BY 1) SELECT stratum, least(m, CASE stratum WHEN 'clear_white' THEN 20 WHEN 'clear_yellow' THEN 20 WHEN 'clear_redtype' THEN 15 WHEN 'ambiguous' THEN 25 ELSE 20 END) AS n FROM q WHERE stratum IS NOT NULL")
def strata_sample(s, d):
    """Sizes of the quota sample; which rows it has depends on the hash order alone."""
    rows = phrases(s, d).select("id", X.stratum(C.categorise_v2(F.col("txt")), F.col("txt")).alias("stratum"))
    quota = {"clear_white": 20, "clear_yellow": 20, "clear_redtype": 15, "ambiguous": 25, "no_mention": 20}
    return V.quota_sample(rows, "stratum", quota, ["id"]).groupBy("stratum").agg(F.count("*").alias("n"))


@REG.query(
    "noise_prevalence",
    r"""WITH f AS (SELECT doc_id, regexp_matches(text, '[0-9]{16}') AS long_number, contains(text, '@') AS mail_address, regexp_matches(text, '!!.*!!') AS shouting, n_chars < 80 AS very_short FROM documents),
u AS (SELECT doc_id, 'long_number' AS signature, long_number AS hit FROM f UNION ALL SELECT doc_id, 'mail_address', mail_address FROM f UNION ALL SELECT doc_id, 'shouting', shouting FROM f UNION ALL SELECT doc_id, 'very_short', very_short FROM f),
c AS (SELECT signature, count(*) FILTER (hit) AS count, round(100.0 * count(*) FILTER (hit) / count(*), 3) AS pct FROM u GROUP BY 1),
e AS (SELECT signature, string_agg(doc_id::VARCHAR, '; ' ORDER BY lpad(doc_id::VARCHAR, 12, '0')) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY lpad(doc_id::VARCHAR, 12, '0')) AS r FROM u WHERE hit) WHERE r <= 8 GROUP BY 1)
SELECT signature, count, pct, coalesce(examples, '') AS examples FROM c LEFT JOIN e USING (signature)""",
)
def noise_prevalence(s, d):
    docs = table(s, d, "documents").withColumn("name", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    t = F.col("text")
    tests = {"long_number": t.rlike("[0-9]{16}"), "mail_address": t.contains("@"), "shouting": t.rlike("!!.*!!"), "very_short": F.col("n_chars") < 80}
    found = O.noise_signatures(docs, "text", "lang", "name", tests)
    bare = F.array_join(F.transform(F.split("examples", "; "), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")), "; ")
    return found.withColumn("examples", bare)


@REG.query(
    "html_links",
    r"""SELECT page_id, i - 1 AS position, ts[i] AS title, CASE WHEN ls[i] LIKE 'http%' THEN ls[i] ELSE 'https://example.org' || ls[i] END AS link
FROM (SELECT page_id, ls, ts, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS ls, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS ts FROM pages))""",
)
def html_links(s, d):
    return O.page_links(table(s, d, "pages").select("page_id", "html"), "html", "https://example.org")


_TABLE_ROW = "'<tr><td>' || s_suppkey || '</td><td><b>' || s_name || '</b> x</td><td><a class=\"f\" href=\"' || CASE WHEN s_suppkey % 2 = 0 THEN 'http://e.org/' ELSE '/v' END || s_suppkey || '.pdf\">get</a></td></tr>'"


@REG.query("table_links", "SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY s_suppkey)::INT AS position, s_name || ' x' AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'http://e.org/' ELSE 'https://example.org/v' END || s_suppkey || '.pdf' AS link FROM (SELECT s_nationkey AS nation, s_suppkey, s_name FROM supplier)")
def table_links(s, d):
    """Links of HTML tables made of suppliers, one table a nation, with a row of too few cells first."""
    rows = table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.expr(_TABLE_ROW).alias("row"))
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "row"))), lambda x: x["row"]), "\n")
    pages = rows.groupBy("nation").agg(F.concat(F.lit("<table><tr><th>n</th><td>head</td></tr>"), one, F.lit("</table>")).alias("html"))
    return O.table_links(pages, "html", "https://example.org")


@REG.query("whitespace_keys", r"SELECT doc_id, lower(trim(regexp_replace(source || '  ' || lang || chr(10) || ' X', '\s+', ' ', 'g'))) AS key, regexp_replace(source || ' ' || lang, '[^A-Za-z0-9]', '_', 'g') AS file FROM documents")
def whitespace_keys(s, d):
    raw = F.concat("source", F.lit("  "), "lang", F.lit("\n X"))
    return table(s, d, "documents").select("doc_id", X.name_key(raw).alias("key"), X.file_safe(F.concat("source", F.lit(" "), "lang")).alias("file"))


def _treatment(k, n):
    """A numbered heading made of a part's key and name, with a body."""
    genus = F.initcap(F.element_at(F.split(n, " "), 2))
    epithet = F.element_at(F.split(n, " "), 1)
    head = F.when(k % 4 == 0, genus).when(k % 4 == 1, F.concat(genus, F.lit(" "), epithet)).when(k % 4 == 2, F.concat(F.substring(genus, 1, 1), F.lit(". "), epithet)).otherwise(F.concat(F.upper(genus), F.lit(" "), epithet))
    body = F.when(k % 3 == 0, F.lit("Herbs erect. Leaves ovate. Flowers white.\nFl. May. Fr. June.")).otherwise(F.lit("see page 12"))
    return F.concat(F.lit("\n"), k.cast("string"), F.lit(". "), head, F.lit("\n"), body)


def _volumes(s, d):
    """Headings of part names, by brand as volume."""
    one = F.struct(F.col("p_partkey").alias("k"), _treatment(F.col("p_partkey"), F.col("p_name")).alias("t"))
    return table(s, d, "part").groupBy(F.col("p_brand").alias("volume")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["t"]), "").alias("text"))


@REG.query(
    "segment_blocks",
    r"""WITH p AS (SELECT p_brand AS volume, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS genus, split_part(p_name, ' ', 1) AS epithet FROM part),
c AS (SELECT *, last_value(CASE WHEN k % 4 < 2 THEN genus END IGNORE NULLS) OVER (PARTITION BY volume ORDER BY pos ROWS UNBOUNDED PRECEDING) AS carried FROM p),
o AS (SELECT *, CASE k % 4 WHEN 0 THEN 'drop_genus_hdr' WHEN 1 THEN 'accept_full' WHEN 2 THEN CASE WHEN k % 3 = 0 AND left(carried, 1) = left(genus, 1) THEN 'accept_abbrev' ELSE 'drop_key' END ELSE 'drop_garbled' END AS outcome FROM c)
SELECT volume, pos::INTEGER AS pos, k::VARCHAR AS number, CASE outcome WHEN 'accept_full' THEN genus WHEN 'accept_abbrev' THEN carried END AS genus, CASE WHEN k % 4 = 0 THEN NULL ELSE epithet END AS epithet, CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END AS score, outcome FROM o""",
)
def segment_blocks(s, d):
    return O.segment(_volumes(s, d), "text", "volume").select("volume", "pos", "number", "genus", "epithet", "score", "outcome")


#: Headings of a text of a volume.
PAGE = 100


def _pages(s, d):
    """The texts of the volumes: headings of part names by brand, a hundred keys a text."""
    page = F.floor(F.col("p_partkey") / PAGE)
    return table(s, d, "part").select(F.col("p_brand").alias("volume"), F.lpad(page.cast("string"), 12, "0").alias("page"), "p_partkey", _treatment(F.col("p_partkey"), F.col("p_name")).alias("t")).groupBy("volume", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "t"))), lambda x: x["t"]), "").alias("text"))


# A mention is a heading with the name whole, in capitals or with its genus abbreviated; its window starts where the heading ends.
_LOCATED = rf"""p AS (SELECT p_brand AS volume, p_partkey AS k, p_partkey // {PAGE} AS page, upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS genus, split_part(p_name, ' ', 1) AS epithet FROM part),
h AS (SELECT *, chr(10) || k || '. ' || CASE k % 4 WHEN 0 THEN genus WHEN 1 THEN genus || ' ' || epithet WHEN 2 THEN left(genus, 1) || '. ' || epithet ELSE upper(genus) || ' ' || epithet END AS head, chr(10) || CASE WHEN k % 3 = 0 THEN 'Herbs erect. Leaves ovate. Flowers white.' || chr(10) || 'Fl. May. Fr. June.' ELSE 'see page 12' END AS body FROM p),
t AS (SELECT volume, page, string_agg(head || body, '' ORDER BY k) AS text FROM h GROUP BY ALL),
e AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY volume, page ORDER BY k) - length(body) AS place FROM h),
w AS (SELECT n.volume, n.genus, n.epithet, e.page, e.place, regexp_extract(substr(text, e.place::INT + 1, 2200), '(?s)^(.*?)(?:\n\s*\d{{1,3}}\s*\.\s+[A-Z][a-z]{{2,}}\s+[a-z]{{3,}}|\bFig\s*\.?\s*\d+|\n\s*[A-Z]{{4,}}(?:\s+[A-Z]{{4,}})*\s*\n|$)', 1) AS win
  FROM (SELECT DISTINCT volume, genus, epithet FROM p) n JOIN e ON n.volume = e.volume AND n.epithet = e.epithet AND ((e.k % 4 IN (1, 3) AND n.genus = e.genus) OR (e.k % 4 = 2 AND left(n.genus, 1) = left(e.genus, 1))) JOIN t ON t.volume = e.volume AND t.page = e.page),
g AS (SELECT *, CASE WHEN win = '' OR length(regexp_replace(left(win, 400), '\D', '', 'g')) > 0.22 * length(left(win, 400)) THEN 0 ELSE len(list_distinct(regexp_extract_all(lower(win), '{L.MORPH}'))) END AS terms FROM w),
b AS (SELECT volume, genus, epithet, arg_min(win, row(-terms, page, place)) AS win FROM g WHERE terms >= 3 GROUP BY ALL),
c AS (SELECT win, lower(substr(win, i, 12)) AS rest, regexp_matches(substr(win, greatest(1, i - 70), least(70, i - 1) + 70 + length(regexp_extract(lower(substr(win, i, 12)), '^{L.COLOURS}', 1))), '(?i){L.ORGANS}') AS organ, i FROM (SELECT win, unnest(range(1, length(win) + 1)) AS i FROM (SELECT DISTINCT win FROM b)) WHERE i = 1 OR regexp_matches(substr(win, i - 1, 1), '\W')),
f AS (SELECT win, arg_min(regexp_extract(rest, '^{L.COLOURS}', 1), i) AS colour FROM c WHERE organ AND regexp_matches(rest, '^{L.COLOURS}') GROUP BY win),
located AS (SELECT n.*, win AS window, colour, CASE WHEN win IS NULL THEN 'not_located' WHEN colour IS NOT NULL THEN 'RECOVERABLE' ELSE 'located_no_colour' END AS status
  FROM (SELECT volume, genus, epithet, min(k) AS p_partkey FROM p GROUP BY ALL) n LEFT JOIN b USING (volume, genus, epithet) LEFT JOIN f USING (win))"""


@REG.query("locate_window", f"WITH {_LOCATED} SELECT * FROM located")
def locate_window(s, d):
    """Names of a volume with the window that describes them."""
    names = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("volume"), F.initcap(F.element_at(F.split("p_name", " "), 2)).alias("genus"), F.element_at(F.split("p_name", " "), 1).alias("epithet"))
    distinct = names.groupBy("volume", "genus", "epithet").agg(F.min("p_partkey").alias("p_partkey"))
    return L.locate_treatments(distinct, _pages(s, d), "volume", "text", "genus", "epithet", "page")


@REG.query("locator_rates", f"WITH {_LOCATED}, r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'control' ELSE 'other' END AS grp, count(*) AS n, avg((status <> 'not_located')::INT) AS located, avg((status = 'RECOVERABLE')::INT) AS recoverable FROM located GROUP BY 1) SELECT r.*, (SELECT located >= 0.8 FROM r WHERE grp = 'control') AS trusted FROM r")
def locator_rates(s, d):
    found = locate_window(s, d).withColumn("grp", F.when(F.col("p_partkey") % 2 == 0, "control").otherwise("other"))
    return L.recovery_rates(found, "grp", "control")


_HAS = lambda pattern, text: f"regexp_matches({text}, '(?i){pattern}')"


@REG.query(
    "validator_flags",
    # Every source is shorter than the window on either side of a colour, so the window is the text.
    f"""WITH {V2_SQL}, r AS (SELECT id, txt AS phrase, 'Flowers ' || txt || '. Fruits red, on ' || CASE WHEN id LIKE '%1' THEN 'hairy leaves' ELSE 'stalks' END || ', in hills, common, rarely seen.' AS source, {CLASS_SQL} AS p FROM v2),
c AS (SELECT *, {" , ".join(f"{_HAS(w, 'source')} AS in_{k}" for k, w in O.CLASS_WORDS.items())}, {" , ".join(f"{_HAS(w, 'phrase')} AS said_{k}" for k, w in O.CLASS_WORDS.items())}, {_HAS(O.FLORAL_TERMS, 'source')} AS floral FROM r),
f AS (SELECT *, CASE p WHEN 'WHITE' THEN in_WHITE WHEN 'YELLOW' THEN in_YELLOW WHEN 'REDTYPE' THEN in_REDTYPE ELSE false END AS found, p IN ('WHITE', 'YELLOW', 'REDTYPE') AS known FROM c),
g AS (SELECT *, CASE WHEN known THEN found AND floral ELSE NOT (floral AND (in_WHITE OR in_YELLOW OR in_REDTYPE)) END AS supported FROM f)
SELECT id, floral AS floral_term_in_source, found AS predicted_colour_in_source, supported AS supported_floral_evidence, found AND NOT floral AND {_HAS(O.OTHER_CONTEXT, 'source')} AND NOT supported AS wrong_context_evidence,
  said_WHITE::INTEGER + said_YELLOW::INTEGER + said_REDTYPE::INTEGER > 1 OR {_HAS(O.SEVERAL, 'phrase')} AS multi_colour_phrase,
  concat_ws('|', CASE WHEN said_WHITE THEN 'WHITE' END, CASE WHEN said_YELLOW THEN 'YELLOW' END, CASE WHEN said_REDTYPE THEN 'REDTYPE' END) AS classes_in_prediction,
  length(source) < {O.SHORTEST} OR {_HAS(O.KEY_STUB, 'source')} AS malformed_or_key_stub, known AND NOT supported AS unsupported_known_colour FROM g""",
)
def validator_flags(s, d):
    ground = F.when(F.col("id").endswith("1"), "hairy leaves").otherwise("stalks")
    rows = phrases(s, d).withColumns({"source": F.concat(F.lit("Flowers "), "txt", F.lit(". Fruits red, on "), ground, F.lit(", in hills, common, rarely seen.")), "class": C.to_class(C.categorise_v2(F.col("txt")))})
    return O.validator_flags(rows, "source", "class", "txt").select("id", "flags.*")


#: Labels, texts and notes made of a part's key and name, so that every rule of the error classes is met.
_CASES = {
    "gold": "CASE WHEN k IN (3, 11) THEN 'REDTYPE' WHEN k IN (5, 6) THEN 'UNKNOWN' ELSE 'WHITE' END",
    "pred": "CASE WHEN k IN (0, 3) THEN 'WHITE' WHEN k = 7 THEN 'UNKNOWN' ELSE 'YELLOW' END",
    "notes": "CASE WHEN k = 1 THEN 'AUTO-FLAG: ' || p_name WHEN k = 2 THEN 'two different colours' WHEN k = 10 AND p_size > 25 THEN 'a Genus-Level note' END",
    "raw": "CASE WHEN k = 4 THEN repeat('Text of a treatment. ', 3) || 'Distrib. Hills. DIPTEROCARPACEAE ' || repeat('More of it. ', p_size) WHEN k = 5 THEN 'Fruit a berry. ' || p_name WHEN k = 9 THEN 'Leaves hairy. ' || p_name ELSE p_name END",
    "gold_text": "CASE WHEN k = 3 THEN 'flowers red and white' WHEN k = 8 THEN 'white, rarely pink' WHEN k = 11 THEN p_name END",
    "pred_text": "CASE WHEN k = 9 THEN 'white' WHEN k = 11 THEN 'yellow' ELSE '' END",
}
_CASE_ROWS = f"SELECT p_partkey AS id, {', '.join(f'{x} AS {c}' for c, x in _CASES.items())} FROM (SELECT *, (p_partkey % 12)::INT AS k FROM part)"
_SAID = "lower(coalesce(gold_text, '') || ' ' || coalesce(pred_text, ''))"
_FOUND = lambda *words: f"regexp_matches({_SAID}, '\\b({'|'.join(words)})\\b')"


@REG.query(
    "error_taxonomy",
    rf"""WITH r AS ({_CASE_ROWS}), f AS (SELECT *, {_FOUND(*O.REDDISH)} AS red, {_FOUND('white', 'whitish')} AS white, {_FOUND('yellow', 'golden')} AS yellow, regexp_extract(raw, '{O.FAMILY}', 1) AS family FROM r),
t AS (SELECT *, strpos(raw, family) - 1 AS place FROM f)
SELECT id, gold, pred, CASE WHEN gold = pred THEN 'CORRECT'
  WHEN coalesce(notes, '') LIKE 'AUTO-FLAG%' OR contains(lower(coalesce(notes, '')), 'genus-level') OR contains(lower(coalesce(notes, '')), 'abbreviated genus') THEN 'JUNK_NON_SPECIES'
  WHEN regexp_matches(upper(coalesce(notes, '')), 'TWO DIFFERENT COLOURS|CONTAMIN|CORYMBOSA') THEN 'CONTAMINATION'
  WHEN red AND ((white AND gold = 'REDTYPE' AND pred = 'WHITE') OR (yellow AND gold = 'REDTYPE' AND pred = 'YELLOW') OR (yellow AND gold = 'YELLOW' AND pred = 'REDTYPE')) THEN 'CATEGORY_PRIORITY'
  WHEN family <> '' AND place > 50 AND regexp_matches(substr(raw, greatest(1, place - 79), least(80, place)), '{O.ENDING}') AND length(raw) - place > 150 THEN 'CONTAMINATION'
  WHEN regexp_matches(raw, '(?i){O.FRUIT}') AND pred <> 'UNKNOWN' AND gold = 'UNKNOWN' THEN 'FRUIT_BERRY_COLOR'
  WHEN gold = 'UNKNOWN' AND pred <> 'UNKNOWN' THEN 'FALSE_POSITIVE' WHEN gold <> 'UNKNOWN' AND pred = 'UNKNOWN' THEN 'FALSE_NEGATIVE'
  WHEN regexp_matches(coalesce(gold_text, ''), '(?i){O.SEVERAL_ERROR}') OR regexp_matches(coalesce(pred_text, ''), '(?i){O.SEVERAL_ERROR}') OR regexp_matches(left(raw, 500), '(?i){O.SEVERAL_ERROR}') THEN 'MULTI_COLOUR'
  WHEN regexp_matches(raw, '(?i){O.INDUMENT}') AND (contains(lower(coalesce(pred_text, '')), 'white') OR contains(lower(coalesce(gold_text, '')), 'white')) THEN 'INDUMENT_TEXTURE' ELSE 'OTHER_MISMATCH' END AS error_class FROM t""",
)
def error_taxonomy(s, d):
    rows = table(s, d, "part").withColumn("k", (F.col("p_partkey") % 12).cast("int")).select(F.col("p_partkey").alias("id"), *(F.expr(x).alias(c) for c, x in _CASES.items()))
    found = O.error_class(*(F.col(c) for c in ("raw", "gold_text", "pred_text", "notes", "gold", "pred")))
    return rows.select("id", "gold", "pred", found.alias("error_class"))


@REG.query("description_scores", r"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 1 END AS score, p_partkey % 3 = 0 AS strong FROM part")
def description_scores(s, d):
    body = F.when(F.col("p_partkey") % 3 == 0, F.lit("Herbs erect. Leaves ovate. Flowers white. Fl. May.")).otherwise(F.lit("the Ovary of"))
    return table(s, d, "part").select("p_partkey", X.description_score(body).alias("score"), X.strong_description(body).alias("strong"))
