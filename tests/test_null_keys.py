"""Null keys in lookups and unions by key."""

from conftest import rows

from tessera.operators import joins as J


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, "", "x"), ("k", "old", "y")], "id string, label string, note string")
    b = spark.createDataFrame([(None, "new", "z"), ("m", "more", "w")], "id string, label string, note string")
    blank = lambda df, *c: rows(df.na.fill("-"), *c)
    assert blank(J.only_new_columns(a.select("id", "note"), b.select("id", "label", "note"), "id")) == [("-", "x", "new"), ("k", "y", "-")]
    assert blank(J.resume(a, b, "id"), "id") == [("k",)]
    assert blank(J.replace_overlap(a, b, ["id"])) == [("-", "new", "z"), ("k", "old", "y"), ("m", "more", "w")]
    assert blank(J.fill_only(a, b, "id", "label", "note")) == [("-", "new", "z"), ("k", "old", "y"), ("m", "more", "w")]
    predictions = spark.createDataFrame([(None, 1, "p"), ("k", 2, "q")], "id string, at int, pred string")
    links = spark.createDataFrame([(None, "s"), ("k", None)], "id string, target string")
    targets = spark.createDataFrame([("s",), (None,), ("t",)], "target string")
    assert blank(J.two_hop(predictions, links, targets, "id", "target", "at"), "target", "pred") == [("-", "q"), ("s", "p"), ("t", "-")]
