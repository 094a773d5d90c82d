"""Connected components, and dealing the members of buckets to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise

#: Members of a bucket that are compared in one task at most twice this number.
BLOCK = 1024


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of edges(a, b).

    Each round hooks every node's neighbourhood to its smallest member, then every
    smaller neighbourhood likewise, and drops repeated edges; stars remain. Hot nodes are
    met by aggregation and adaptive joins only. Each round's edges are a table in the
    shared folder, so the lineage stays one round long.
    """
    spark = edges.sparkSession
    now, path = materialise(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        # Large star: every larger neighbour of a node hangs on the smallest of the neighbourhood.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        # Small star: the smaller neighbours of a node, and the node, hang on the smallest of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        new, new_path = materialise(small.filter("a != b").distinct(), "edges")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, path)
        now, path = new, new_path
        if state == before:
            break
        before = state
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def deal(rows: DataFrame, key: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """rows with _g (bucket and pair of blocks) and _side (0: the first block, 1: the second, 2: both are this one).

    Buckets with one member are dropped. A bucket of up to block members is one group; a
    larger one is cut into blocks by a hash of the member, and every pair of blocks is a
    group: all pairs of members meet, none in two groups, and no group has much more than
    two blocks.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    cut = rows.join(sizes, key).withColumn("_k", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    mine = F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_k")).cast("int")
    spread = cut.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    first, second = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    side = F.when(F.col("_mine") == F.col("_other"), 2).when(F.col("_mine") < F.col("_other"), 0).otherwise(1)
    return spread.select(
        *[c for c in rows.columns if c not in key],
        F.xxhash64(*key, first, second).alias("_g"),
        side.cast("int").alias("_side"),
        *[F.col(c) for c in key],
        first.alias("_i"),
        second.alias("_j"),
    ).drop("_n", "_k")
