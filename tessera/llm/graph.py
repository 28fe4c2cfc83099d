"""Connected components of links, and checkpoints on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the folder that the session names.

    Where the session names none, the folder lies in the warehouse, which a cluster shares as well.
    """
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


#: Edges that a task of a round takes, so that a small graph is not dealt out to hundreds of tasks.
TASK_EDGES = 100_000


def _tasks(edges: int) -> int:
    return max(1, -(-edges // TASK_EDGES))


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); a component's name is its smallest node.

    Alternating star contraction: a large-star step hangs every larger neighbour of a node under the
    node's smallest neighbour, a small-star step every smaller one; rounds end when nothing changes,
    after a number of them that grows with the logarithm of the graph.  Rows stay in proportion to
    the links throughout, and minima are taken with partial sums before each shuffle, so a node with
    many links is no hot task.  Self links and null ends are ignored.
    """
    # Cut off at once: every round reads its edges several times, and plans would hold what made them as often.
    edges = checkpointed(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, tasks = None, _tasks(edges.count())
    while True:
        held = edges.coalesce(tasks)
        both = held.select("u", "v").unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(under, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = checkpointed(small.where(F.col("u") != F.col("v")).coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, tasks = now, _tasks(now[0])
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
