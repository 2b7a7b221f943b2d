"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import hold, release


def components(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for each node of an undirected graph.

    edges: two columns of one orderable type. Returns (node, root) for every node that has an edge to another
    node; self links and repeated links are allowed, null ends are dropped. Each round is two aggregations whose
    results are written to the shared folder; a hub's neighbours are never gathered into one row, since the stars
    use the minimum of each neighbourhood only. Rounds grow with the logarithm of the longest chain.
    """
    e = (
        edges.select(F.least(left, right).alias("v"), F.greatest(left, right).alias("u"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = hold(e, "links")  # each link once: v < u
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of u is linked to the smallest of u's neighbourhood
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = hold(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), "least")  # a table, so that the join can split a hub
        large = (
            both.where("y > x").join(low, "x").select(F.col("m").alias("v"), F.col("y").alias("u")).where("u <> v").distinct()
        )
        # small star: u and its smaller neighbours are linked to the smallest of them
        large = hold(large, "large")
        low2 = hold(large.groupBy("u").agg(F.min("v").alias("m")), "low")  # tables on both sides, as above
        small = (
            large.join(low2, "u")
            .select(F.col("m").alias("v"), F.explode(F.array("u", "v")).alias("u"))
            .where("u <> v")
            .distinct()
        )
        new = hold(small, "links")
        now = new.agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("u").alias("k"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        ).first()
        release(e)
        release(low)
        release(large)
        release(low2)
        e = new
        # every node has one parent, and no parent has a parent: stars
        if now["n"] == now["k"] and before == (now["n"], now["s"]):
            break
        before = (now["n"], now["s"])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
