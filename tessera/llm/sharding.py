"""Reproducible shuffle and sharding without a sort of the corpus.

Rows get global row numbers 0..N-1; a Feistel permutation over [0, a) x [0, b), the smallest such
grid of near-square sides that holds N, with cycle walking back into [0, N), shuffles them; the
permuted number p is shard ``p mod shards``, slot ``p div shards``.  So a row's place is computed
from its number alone, shards differ by at most one row and slots have no gap (law ``rows``).

DataFrame functions only.  Row numbers come from hash buckets: rows are counted per bucket (partial
sums before the shuffle), offsets are running sums over the fixed number of buckets, and a window
numbers each bucket.  Equal rows are counted first and expanded after, so no repeated row makes a
hot bucket.

Defined cases: null texts have 0 bytes; null ids are ids like any other; repeated rows take
consecutive numbers; fewer rows than shards leave the last shards empty; an empty table gives an
empty result; only the columns named by the caller are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Hash buckets of the row numbering; a fixed number, so their offsets are a table of fixed size.
BUCKETS = 8192
#: Multiplier and addend of each Feistel round (fixed values; an even number of rounds).
ROUNDS = [(1103515245, 12345), (1664525, 1013904223), (214013, 2531011), (22695477, 907633385), (69069, 362437), (134775813, 521288629)]
#: Steps of a cycle walk.  Each step leaves the range with probability below 1/sqrt(N), so a walk
#: of more is not met in practice; one would stop the job rather than give a wrong place.
WALK = 64


def size_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def permute(x: Column, a: Column, b: Column, seed: int = 0) -> Column:
    """One pass of the Feistel permutation of [0, a * b)."""
    keys = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit((c + seed) % 2147483647).cast("long").alias("c")) for m, c in ROUNDS))

    def step(s: Column, k: Column) -> Column:
        mixed = ((s["r"] % 1000003) * k["m"] + F.floor(s["r"] / 1000003) * 69621 + k["c"]) % 2147483647
        return F.struct(s["r"].alias("l"), ((s["l"] + mixed) % s["a"]).alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    start = F.struct(F.expr("cast(0 as bigint)").alias("l"), F.expr("cast(0 as bigint)").alias("r"), a.alias("a"), b.alias("b"))
    start = start.withField("l", F.floor(x / b).cast("long")).withField("r", (x % b).cast("long"))
    return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])


def shuffled_place(row: Column, n: Column, a: Column, b: Column, seed: int = 0) -> Column:
    """The place of row number ``row`` among ``n`` rows: permute until the value is below n."""
    first = permute(row, a, b, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(permute(x, a, b, seed)))
    return F.when(first < n, first).otherwise(F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a cycle walk was too long")).cast("long")))


def number_rows(df: DataFrame, bucket: Column, out: str = "row") -> DataFrame:
    """All rows of ``df`` with a global number; the order is (bucket, columns), deterministic."""
    cols = df.columns
    counted = df.withColumn("__bucket", bucket.cast("int")).groupBy("__bucket", *cols).agg(F.count("*").alias("__copies"))
    sums = counted.groupBy("__bucket").agg(F.sum("__copies").alias("__in_bucket"))
    before = W.Window.orderBy("__bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sums.select("__bucket", F.coalesce(F.sum("__in_bucket").over(before), F.lit(0)).alias("__offset"), F.sum("__in_bucket").over(W.Window.partitionBy()).alias("__n"))
    own = W.Window.partitionBy("__bucket").orderBy(*cols).rowsBetween(W.Window.unboundedPreceding, -1)
    numbered = counted.withColumn("__first", F.coalesce(F.sum("__copies").over(own), F.lit(0)))
    numbered = numbered.join(F.broadcast(offsets), "__bucket")  # BUCKETS rows at most
    each = F.explode(F.sequence(F.col("__offset") + F.col("__first"), F.col("__offset") + F.col("__first") + F.col("__copies") - 1))
    return numbered.select(*cols, "__n", each.alias(out))


def shard_rows(df: DataFrame, bucket: Column, shards: int = 40, seed: int = 0) -> DataFrame:
    """All rows of ``df`` with ``shard`` and ``slot`` under the law of equal row counts."""
    numbered = number_rows(df, bucket, "__row")
    n = F.col("__n")
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.ceil(n / a).cast("long")
    sided = numbered.withColumns({"__a": a, "__b": b})
    place = shuffled_place(F.col("__row"), n, F.col("__a"), F.col("__b"), seed)
    placed = sided.withColumn("__place", place)
    return placed.select(*df.columns, (F.col("__place") % shards).cast("int").alias("shard"), F.floor(F.col("__place") / shards).cast("long").alias("slot"))


def id_bucket(id_col: Column, crc: Column) -> Column:
    """A bucket from an integer id and a text checksum; null ids spread by their texts."""
    return (F.pmod(F.coalesce(id_col, F.lit(0)), F.lit(1000000007)) * 2654435761 + crc) % BUCKETS


#: DuckDB SQL for the same places: crc32 by its table, the numbering, the rounds, a recursive walk.
def oracle(shards: int = 40, seed: int = 0) -> str:
    rounds = "SELECT p, n, a, b, x // b AS l, x % b AS r, a AS s, b AS t FROM {src}"
    for m, c in ROUNDS:
        rounds = f"SELECT p, n, a, b, r AS l, (l + ((r % 1000003) * {m} + (r // 1000003) * 69621 + {(c + seed) % 2147483647}) % 2147483647) % s AS r, t AS s, s AS t FROM ({rounds})"
    once = f"SELECT p, n, a, b, l * b + r AS x FROM ({rounds})"
    return f"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM bits),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, z: xor(c // 256, tab[(xor(c, z) % 256) + 1])), 4294967295::BIGINT) AS crc
  FROM documents, crc_table),
k AS (SELECT *, (((coalesce(doc_id, 0) % 1000000007 + 1000000007) % 1000000007) * 2654435761 + crc) % {BUCKETS} AS bucket FROM d),
numbered AS (SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, crc) - 1 AS p, count(*) OVER () AS n FROM k),
sides AS (SELECT p, n, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b, p AS x FROM numbered),
walk AS (
  {once.format(src="sides")}
  UNION ALL
  {once.format(src="(SELECT * FROM walk WHERE x >= n)")}),
placed AS (SELECT p, x FROM walk WHERE x < n)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (x % {shards})::INTEGER AS shard, x // {shards} AS slot, NULL::INTEGER AS grown_shard
FROM numbered JOIN placed USING (p)"""
