"""Connected components of an edge table by alternating stars; nothing is gathered on the driver."""

from pyspark.sql import functions as F

from busfleet.llm._text import stored


def _star(edges, large):
    """One round: each node's neighbours (the larger, or the smaller ones) go to the least of all."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges):
    """Whether each node points to one least node that points nowhere."""
    roles = edges.select("a", F.lit(1).alias("child")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("child")))
    open_ = roles.groupBy("a").agg(F.sum("child").alias("up"), F.min("child").alias("least")).where("up > 1 or (up = 1 and least = 0)")
    return open_.isEmpty()


def components(edges, most=60):
    """(a, b) edges of long ids -> (node, component): each node that has an edge, with its least node.

    Repeated edges, loops and both directions may occur; an empty table gives no rows. The rounds are
    about the logarithm of the longest chain; each is written to the shared folder.
    """
    edges = edges.select("a", "b").where("a <> b")
    for _ in range(most):
        edges = stored(_star(_star(edges, True), False), "edges")
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {most} rounds")
