"""Text functions and operators on hand-worked cases."""

from conftest import rows
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import similarity
from tessera.operators import text_ops as O


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_scalars(spark):
    assert one(spark, "  A  b\n c ", X.whitespace_normal) == "A b c"
    assert one(spark, None, X.name_key) == ""
    assert one(spark, "FLORA VOL. 12.txt", X.volume_of) == "12"
    assert one(spark, "zeylanica(L.)", X.epithet_lead) == "zeylanica"
    assert one(spark, "ab-- x", X.epithet_lead) == "ab"
    assert one(spark, "Li", X.epithet_lead) is None
    assert one(spark, "X2 = 31.246, df = 8", lambda c: X.number_in(c, r"= ([\d.]+),")) == 31.246
    assert one(spark, "none", lambda c: X.number_in(c, r"(\d+)")) is None
    assert [one(spark, v, X.truth) for v in ("true", "1", "no", None)] == [True, True, False, False]


def test_bands_are_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 500.0, 500.01, 1500.0, 3000.0, 4500.0, 4500.01, None)], "a double")
    assert [r[0] for r in df.select(X.cut(F.col("a"), X.ELEVATION)).collect()] == ["1", "1", "2", "2", "3", "4", "5", None]


def test_families(spark):
    names = ["bio1", "bio2", "bio5", "bio11", "bio12", "bio15", "bio19", "clay", "alt"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    assert [r[0] for r in df.select(X.variable_family(F.col("v"))).collect()] == ["Temperature", "Seasonality", "Seasonality", "Temperature", "Precipitation", "Seasonality", "Precipitation", "Soil", "Others"]


def test_segmentation(spark):
    text = "x\n1. Clematis L.\nwoody\n2. Clematis montana Buch.\nHerbs. Fl. May\n3. C. nutans Royle\nHerbs erect. Leaves. Fl. May\n4. C. xyzz\nshort\n5. CLEMATIS foo\nbar"
    found = O.segment(spark.createDataFrame([("1", text), ("2", None)], "volume string, text string"), "text", "volume")
    assert [(r.number, r.genus, r.epithet, r.outcome) for r in found.orderBy("pos").collect()] == [("1", None, None, "drop_genus_hdr"), ("2", "Clematis", "montana", "accept_full"), ("3", "Clematis", "nutans", "accept_abbrev"), ("4", None, "xyzz", "drop_key"), ("5", None, "foo", "drop_garbled")]


def test_validator():
    source = "Shrubs to two metres tall with many branches. Flowers white, in dense panicles at ends of branches; fruits red when they are ripe."
    flags = O.validate(source, "WHITE", "flowers white")
    assert flags == (True, True, True, False, False, "WHITE", False, False)
    assert O.validate(source, "YELLOW", "yellow or white")[2:8] == (False, False, True, "WHITE|YELLOW", False, True)
    assert O.validate("", None, None)[6] is True


def test_tfidf_top_k_counts_texts_without_shared_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha beta"), (3, "gamma delta"), (4, "gamma delta"), (5, "zz")], "k long, t string")
    w = O.tfidf(docs, "k", "t")
    top = similarity.top_similar(docs.select("k"), docs.select("k"), "k", w, 2)
    got = {(r.query, r["rank"]): (r.k, round(r.similarity, 3)) for r in top.collect()}
    assert got[(1, 1)][0] == 2 and got[(1, 2)] == (5, 0.0)
    assert got[(5, 1)] == (4, 0.0) and got[(5, 2)] == (3, 0.0)
    assert len(got) == 10


def test_error_class_order(spark):
    df = spark.createDataFrame([("", "", "", "AUTO-FLAG: x", "WHITE", "YELLOW"), ("", "red and white", "white", "", "REDTYPE", "WHITE"), ("a fruit", "", "", "", "UNKNOWN", "REDTYPE"), ("", "", "", "", "UNKNOWN", "WHITE"), ("", "", "", "", "WHITE", "UNKNOWN"), ("rarely", "", "", "", "WHITE", "YELLOW"), ("hairy", "", "white", "", "WHITE", "OTHER"), ("", "", "", "", "WHITE", "OTHER"), ("", "", "", "", "WHITE", "WHITE")], "raw string, g string, p string, notes string, gold string, pred string")
    got = [r[0] for r in df.select(O.error_class(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["JUNK_NON_SPECIES", "CATEGORY_PRIORITY", "FRUIT_BERRY_COLOR", "FALSE_POSITIVE", "FALSE_NEGATIVE", "MULTI_COLOUR", "INDUMENT_TEXTURE", "OTHER_MISMATCH", "CORRECT"]


def test_table_links(spark):
    html = '<table><tr><td>1</td><td><b>Vol</b> 1</td><td><a href="/v1.pdf">get</a></td></tr><tr><td>x</td></tr></table>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert rows(O.table_links(pages, "html", "https://e.org")) == [(1, 0, "Vol 1", "https://e.org/v1.pdf")]
