"""Verbs, joins, reshaping, readers and writers on small tables."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import reshape as R
from tessera.operators import select as Z
from tessera.operators import verbs as V
from tessera.schemas import strings
from tessera.sources import readers, sinks
from tessera.streaming import resume


def df(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_ties_follow_ingestion(spark):
    t = df(spark, [("a", 3, 1), ("a", 3, 2), ("b", 1, 3), (None, 5, 4)], "k string, s int, i int")
    assert sorted((r.k or "", r.i) for r in V.best_rows(t, "k", F.col("s"), "i").collect()) == [("", 4), ("a", 1), ("b", 3)]
    assert sorted((r.k or "", r.i) for r in V.last_wins(t, "k", "i").collect()) == [("", 4), ("a", 2), ("b", 3)]


def test_filter_out_keeps_nulls(spark):
    t = df(spark, [(1,), (2,), (None,)], "x int")
    assert sorted(str(r.x) for r in V.filter_out(t, F.col("x") == 1).collect()) == ["2", "None"]


def test_consecutive_runs_treat_nulls_as_equal(spark):
    t = df(spark, [(1, None), (2, None), (3, "a"), (4, "a"), (5, None)], "i int, v string")
    assert [r.run for r in V.consecutive_id(t, "v", ["i"]).orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_join_matches_nulls_and_checks(spark):
    a, b = df(spark, [(1, "x"), (None, "n")], "k int, v string"), df(spark, [(None, "m"), (1, "y"), (1, "z")], "k int, v string")
    got = J.mutating_join(a, b, ["k"], "left")
    assert got.columns == ["k", "v.x", "v.y"] and got.count() == 3
    assert J.mutating_join(a, b, ["k"], "left", multiple="first").count() == 2
    with pytest.raises(ValueError, match="repeats"):
        J.mutating_join(a, b, ["k"], relationship="one-to-one")
    with pytest.raises(ValueError, match="no match"):
        J.mutating_join(a, b.where("k is not null"), ["k"], unmatched="error")


def test_fill_only_never_overwrites(spark):
    a, b = df(spark, [("1", "W", "ta"), ("2", "", "tb"), ("3", None, "tc")], "k string, l string, t string"), df(spark, [("1", "Y", "ua"), ("2", "R", "ub"), ("4", "P", "ud")], "k string, l string, t string")
    assert rows(J.fill_only(a, b, "k", "l", "t").na.fill("-")) == [("1", "W", "ta"), ("2", "R", "ub"), ("3", "-", "tc"), ("4", "P", "ud")]


def test_asof_takes_the_last_before(spark):
    a, b = df(spark, [(1, 5), (1, 10), (2, 1)], "k int, t int"), df(spark, [(1, 4, 7), (1, 5, 8), (1, 11, 9)], "k int, t int, v int")
    assert rows(J.asof_join(a, b, ["k"], "t", "t", ["v"], "v").na.fill(-1)) == [(1, 5, 8), (1, 10, 8), (2, 1, -1)]


def test_wide_pairs_need_one_row_of_each(spark):
    t = df(spark, [("e", "a", 1.0), ("e", "b", 2.0)], "k string, s string, v double")
    assert rows(J.pair_wide(t, ["k"], "s", ("a", "b"), ["v"])) == [("e", 1.0, 2.0)]
    with pytest.raises(Exception, match="not one row"):
        J.pair_wide(t.union(t), ["k"], "s", ("a", "b"), ["v"]).collect()


def test_row_changes(spark):
    a, b = df(spark, [(1, None), (2, "b")], "k int, v string"), df(spark, [(1, "x"), (3, "y")], "k int, v string")
    assert rows(J.rows_upsert(a, b, ["k"])) == [(1, "x"), (2, "b"), (3, "y")]
    assert rows(J.rows_patch(a, b, ["k"], "ignore")) == [(1, "x"), (2, "b")]
    with pytest.raises(ValueError, match="exists"):
        J.rows_insert(a, b, ["k"])


def test_selection_rules(spark):
    t = df(spark, [(1, 2, "a", 3)], "x1 int, x2 int, name string, y int")
    assert Z.resolve(t, Z.num_range("x", [1, 2, 3])) == ["x1", "x2"]
    assert Z.resolve(t, Z.both(Z.where(Z.is_numeric), Z.exclude(Z.matches("^x")))) == ["y"]
    assert Z.relocate(t, "y", after="x1").columns == ["x1", "y", "x2", "name"]
    with pytest.raises(ValueError, match="missing"):
        Z.require(t, ["zz"])


def test_reshape_round_trips(spark):
    t = df(spark, [(1, "a", 2), (1, "b", 3), (2, "a", 4)], "k int, n string, v int")
    wide = R.pivot_wider(t, ["k"], "n", ["a", "b"], F.sum("v"), fill=0)
    assert rows(wide) == [(1, 2, 3), (2, 4, 0)]
    assert rows(R.unnest(R.nest(t, ["k"]), "data")) == rows(t)
    assert rows(R.complete(t, "k", "n", fill={"v": 0})) == [(1, "a", 2), (1, "b", 3), (2, "a", 4), (2, "b", 0)]
    up = R.fill_down(df(spark, [(1, None), (2, 5), (3, None)], "i int, v int"), ["v"], ["i"], [], "updown")
    assert rows(up) == [(1, 5), (2, 5), (3, 5)]


def test_csv_keeps_blanks_and_multiline(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿species_id,text\n,"a\nb ""q"""\nx,\n', encoding="utf-8")
    t = readers.read_csv(spark, str(path), strings("species_id", "text"))
    assert rows(t) == [("", 'a\nb "q"'), ("x", "")]
    assert readers.header_of(spark, str(path)) == ["species_id", "text"]
    assert readers.read_optional(spark, str(tmp_path / "none.csv"), strings("a")) is None


def test_volumes_and_manifest(spark, tmp_path):
    (tmp_path / "FLORA VOL 3.txt").write_text("hello\nworld")
    assert rows(readers.read_volumes(spark, str(tmp_path / "*.txt"))) == [("3", "hello\nworld")]
    (tmp_path / "m.csv").write_text("# note\n1,a,b\n2,c\n")
    assert rows(readers.read_manifest(spark, str(tmp_path / "m.csv"), strings("n", "slug", "pdf"))) == [("1", "a", "b")]
    assert readers.parse_tasks(["i::t::k::o"])[0].key == "k"
    with pytest.raises(ValueError):
        readers.parse_tasks(["i::t"])


def test_fetch_asks_for_what_is_missing(spark):
    keys = df(spark, [("a",), ("b",), ("c",)], "name string")
    cache = df(spark, [("a",)], "name string")

    def client(k):
        if k == "c":
            raise RuntimeError("down")
        return "success", [{"lat": 1.0}, {"lat": 2.0}]

    got = rows(readers.fetch_records(keys, "name", cache, client, "lat double").na.fill(-1).na.fill(""))
    assert got == [("b", "success", "", 1.0), ("b", "success", "", 2.0), ("c", "error", "down", -1.0)]


def test_append_is_resumable_and_streams(spark, tmp_path):
    t = df(spark, [("a", "red x"), ("", "blank key")], "id string, text string")
    out = str(tmp_path / "out")
    sinks.append_new(readers.extract(t, "id", "text", lambda s: s.split()[0]), out, "id")
    again = sinks.append_new(readers.extract(t.union(df(spark, [("b", "")], "id string, text string")), "id", "text", lambda s: s.split()[0]), out, "id")
    assert rows(again) == [("", "blank"), ("a", "red"), ("b", "ERROR: list index out of range")]
    t.write.parquet(str(tmp_path / "src"))
    q = resume.extract_stream(spark, str(tmp_path / "src"), t.schema, "id", "text", str.upper, str(tmp_path / "o2"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "o2"))) == [("", "BLANK KEY"), ("a", "RED X")]


def test_sinks(spark, tmp_path):
    one = df(spark, [(1, ["a"])], "n int, l array<string>")
    assert sinks.write_json(one, str(tmp_path / "s.json")) == json.loads((tmp_path / "s.json").read_text())
    sinks.write_csv(df(spark, [], "a string, b string"), str(tmp_path / "empty"), ["a"])
    notes = df(spark, [("x", "y"), (None, "y"), ("x", " ")], "notes string, more string")
    assert rows(sinks.append_notes(notes, "notes", "more")) == [("x",), ("x | y",), ("y",)]


def test_mutate_sees_earlier_columns_and_places_new_ones(spark):
    t = df(spark, [(1, 2)], "a int, b int")
    out = V.mutate(t, after="a", c=F.col("a") + 1, d=F.col("c") * 10)
    assert out.columns == ["a", "c", "d", "b"] and tuple(out.first()) == (1, 2, 20, 2)
    assert V.mutate(t, keep="none", c=F.col("a")).columns == ["c"]


def test_samples_do_not_depend_on_partitions(spark):
    t = spark.range(1000).withColumnRenamed("id", "k")
    pick = lambda x: rows(V.slice_fraction(x, 0.1, ["k"]))
    assert pick(t) == pick(t.repartition(7)) and 60 < len(pick(t)) < 140
    assert V.pull(t.limit(3), "k", "k") == [0, 1, 2]
    assert V.setequal(t, t.repartition(3)) and not V.setequal(t, t.limit(5))
