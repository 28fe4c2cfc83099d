"""The permutation, the laws of shards, and defined cases."""

from zlib import crc32

from pyspark.sql import functions as F

from tessera.llm import sharding as S


def place(spark, rows, shards=40):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    keys = df.select("doc_id", S.size_bytes(F.col("text")).alias("size"), S.text_crc32(F.col("text")).alias("crc"))
    return S.shard_rows(keys, S.id_bucket(F.col("doc_id"), F.col("crc")), shards).collect()


def test_permutation_is_one(spark):
    for a, b in ((1, 1), (2, 3), (7, 7), (31, 40)):
        n = a * b
        df = spark.range(n).select(S.permute(F.col("id"), F.lit(a).cast("long"), F.lit(b).cast("long"), 3).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_shards_are_even_and_gapless(spark):
    out = place(spark, [(i, f"text {i % 50}", None) for i in range(997)])
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(slots) == 40 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = {(r.doc_id, r.shard, r.slot) for r in place(spark, [(i, f"text {i % 50}", None) for i in reversed(range(997))])}
    assert again == {(r.doc_id, r.shard, r.slot) for r in out}
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order)


def test_defined_cases(spark):
    rows = [(None, None, "x")] * 5 + [(1, "é", "x")] * 3 + [(2, "", "x")]
    out = place(spark, rows, shards=4)
    assert len(out) == 9 and sorted((r.shard, r.slot) for r in out) == sorted((p % 4, p // 4) for p in range(9))
    assert {(r.size, r.crc) for r in out if r.doc_id == 1} == {(18, crc32("é".encode()))}
    assert {(r.size, r.crc) for r in out if r.doc_id is None} == {(16, 0)}
    assert place(spark, []) == [] and len(place(spark, [(1, "a", None)])) == 1
    assert len(place(spark, [(-5, "a", None), (1 << 62, "b", None)])) == 2
