"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.session import materialize, release


#: Edges of a node from which they are spread over several tasks.
HOT = 100_000


def _with_least(rows: DataFrame, least: DataFrame, hot: int, edges: int) -> DataFrame:
    """``rows`` (a, b) joined to the one row of ``least`` for each a; the rows of a node with more than ``hot`` are salted."""
    if edges <= hot:
        return rows.join(least, "a")
    large = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("a", F.ceil(F.col("n") / hot).alias("salts"))
    large = materialize(large, "hot")  # no more than edges / hot rows
    salts = F.coalesce("salts", F.lit(1).cast("bigint"))
    left = rows.join(F.broadcast(large), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts)).drop("salts")
    right = least.join(F.broadcast(large), "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("salts")
    return left.join(right, ["a", "salt"]).drop("salt")


def components(edges: DataFrame, most_rounds: int = 60, hot: int = HOT) -> DataFrame:
    """``(node, label)``: for each node of ``edges`` (a, b) the smallest node of its component.

    Alternates large-star and small-star steps: every node links its greater
    neighbours, then all its neighbours, to the smallest one it knows. Edges
    are pre-aggregated as distinct pairs, a component ends as a star, and the
    number of rounds is about the logarithm of the diameter. The edges of a
    node with more than ``hot`` are spread over several tasks. Each round is
    written to the shared folder. Loops and repeated edges do no harm; no edges
    give no rows.
    """
    now = materialize(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "edges")
    before, held = None, now.count()
    for _ in range(most_rounds):
        # large-star
        both = now.where("a <> b").select("a", "b").unionByName(now.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _with_least(both.where("b > a"), least, hot, held).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(down, lowest, hot, held).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = materialize(small.where("a <> b").distinct(), "edges")
        state = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        release(now)
        now, held = new, state.n
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("no end of the rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return stars.unionByName(roots)
