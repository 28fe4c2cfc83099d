"""Branches of pivots, separations, joins and summaries that no query takes."""

import datetime

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.functions import values as Y
from tessera.operators import joins as J
from tessera.operators import reshape as R
from tessera.operators import scoring as S
from tessera.operators import select as Z
from tessera.operators import verbs as V


def test_pivot_wider_values(spark):
    df = spark.createDataFrame([("a", "x", 1, 5), ("a", "x", 2, 6), ("b", "y", 1, 7), ("b", None, 2, 8)], "id string, k string, t int, v int")
    wide = R.pivot_wider_values(df, ["id"], {"k": ["x", "y", None]}, {"n": F.count(F.lit(1)), "total": F.sum("v")}, fill={"n": 0})
    assert wide.columns == ["id", "n_x", "n_y", "n_NA", "total_x", "total_y", "total_NA"]
    assert rows(wide) == [("a", 2, 0, 0, 11, None, None), ("b", 0, 1, 1, None, 7, 8)]
    one = R.pivot_wider_values(df, ["id"], {"k": ["x", "y"], "t": [1, 2]}, {"v": F.sum("v")}, only=[("x", 1), ("y", 1)], names_sep="-")
    assert one.columns == ["id", "x-1", "y-1"] and rows(one.fillna(0)) == [("a", 5, 0), ("b", 0, 7)]
    every = R.pivot_wider_values(df, ["id", "t"], {"k": ["x"]}, {"v": F.sum("v")}, id_expand=True, unused={"least": F.min("v")})
    assert rows(every.fillna(0)) == [("a", 1, 5, 5), ("a", 2, 6, 6), ("b", 1, 0, 7), ("b", 2, 0, 8)]


def test_pivot_longer_by_separator_and_order(spark):
    df = spark.createDataFrame([(1, 10, 20), (2, 30, 40)], "id int, x_1 int, x_2 int")
    out = R.pivot_longer_sep(df, ["x_1", "x_2"], "_", ["k", "t"], "v", {"t": "int"})
    assert rows(out, "id", "k", "t", "v") == [(1, "x", 1, 10), (1, "x", 2, 20), (2, "x", 1, 30), (2, "x", 2, 40)] and dict(out.dtypes)["t"] == "int"
    longer = R.pivot_longer(df, ["x_1", "x_2"])
    assert [r.value for r in R.arrange_longer(longer, ["id"], "name", ["x_1", "x_2"]).collect()] == [10, 20, 30, 40]
    assert [r.value for r in R.arrange_longer(longer, ["id"], "name", ["x_1", "x_2"], "slowest").collect()] == [10, 30, 20, 40]


def test_separate_by_delimiter(spark):
    df = spark.createDataFrame([(1, "a-b"), (2, "a"), (3, "a-b-c-d"), (4, None)], "id int, s string")
    cut = lambda few, many, of=df: rows(R.separate_wider_delim(of, "s", "-", ["p", "q"], few, many).na.fill("."), "id", "p", "q")
    assert cut("align_start", "drop") == [(1, "a", "b"), (2, "a", "."), (3, "a", "b"), (4, ".", ".")]
    assert cut("align_end", "merge") == [(1, "a", "b"), (2, ".", "a"), (3, "a", "b-c-d"), (4, ".", ".")]
    assert cut("error", "error", df.where("id IN (1, 4)")) == [(1, "a", "b"), (4, ".", ".")]
    for bad, rule in ((2, ("error", "drop")), (3, ("align_start", "error"))):
        with pytest.raises(Exception, match="parts of s"):
            R.separate_wider_delim(df.where(f"id = {bad}"), "s", "-", ["p", "q"], *rule).collect()
    debug = R.separate_wider_delim(df, "s", "-", ["p", "q"], "debug", "debug").orderBy("id").collect()
    assert [(r.s_ok, r.s_pieces, r.s_remainder) for r in debug] == [(True, 2, ""), (False, 1, ""), (False, 4, "-c-d"), (True, None, None)]


def test_unite_says_missing(spark):
    df = spark.createDataFrame([("a", None), (None, "b")], "x string, y string")
    assert rows(R.unite(df, "z", ["x", "y"])) == [("a",), ("b",)]
    assert rows(R.unite(df, "z", ["x", "y"], "-", na_rm=False)) == [("NA-b",), ("a-NA",)]


def test_join_checks_and_kept_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k int, w string")
    assert J.mutating_join(a, b, ["k"], keep=True).columns == ["k.x", "k.y", "v", "w"]
    assert rows(J.mutating_join(a, b, ["k"], "full", keep=True, suffix=("_a", "_b")).na.fill(0).na.fill("")) == [(0, 3, "", "r"), (1, 1, "x", "p"), (1, 1, "x", "q"), (2, 0, "y", "")]
    assert rows(J.mutating_join(a, b, ["k"], "inner", multiple="any")) == [(1, "x", "p")]
    assert J.mutating_join(a, b.where("w = 'p'"), ["k"], multiple="error", unmatched_right="error").count() == 2
    with pytest.raises(ValueError, match="several"):
        J.mutating_join(a, b, ["k"], multiple="error")
    with pytest.raises(ValueError, match="right row"):
        J.mutating_join(a, b, ["k"], unmatched_right="error")


def test_a_metric_of_ones_own(spark):
    counts = spark.createDataFrame([("m", "a", "a", 60), ("m", "a", "b", 20), ("m", "b", "b", 20)], "model string, gold string, pred string, n long")

    def right(draws, gold, pred):
        return draws[:, gold == pred].sum(axis=1) / draws.sum(axis=1)

    own, named = (S.metric_bootstrap(counts, ["model"], m, 400, 7).first() for m in (right, "accuracy"))
    assert (own.low, own.high) == (named.low, named.high) and np.isclose((own.low + own.high) / 2, 0.8, atol=0.05)


def test_groups_picks_counts_and_labels(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", None, 4)], "g string, k string, v int")
    first = V.summarise_groups(V.Grouped(df, ("g", "k")), n=F.sum("v"))
    assert first.by == ("g",) and V.summarise_groups(first, "drop", n=F.max("n")).by == ()
    assert V.summarise_groups(V.Grouped(df, ("g",)), "keep", n=F.sum("v")).by == ("g",)
    assert V.summarise_groups(V.Grouped(df, ("g",)), "rowwise", n=F.sum("v")).by == ("g", "n")
    with pytest.raises(ValueError, match="no grouping"):
        V.summarise_groups(first, "other", n=F.max("n"))
    assert rows(V.pack_counts(df.union(df.where("g = 'a' AND k = 'y'")), "g", "k")) == [("a", '{"y":2,"x":1}'), ("b", '{"x":1}')]
    assert rows(df.select(F.array_max(Z.c_across(df, "v")), *Z.pick(df, "g")).distinct())[0] == (1, "a")
    said = spark.createDataFrame([("2024-02-29", 1234567.5, 0.256), ("29/02/2024", None, None), ("soon", 0.0, 1.0)], "d string, x double, p double")
    got = [tuple(r) for r in said.select(Y.parse_date(F.col("d"), "yyyy-MM-dd", "dd/MM/yyyy"), Y.comma(F.col("x"), 1), Y.percent(F.col("p"))).collect()]
    assert got == [(datetime.date(2024, 2, 29), "1,234,567.5", "26%"), (datetime.date(2024, 2, 29), None, None), (None, "0.0", "100%")]
