"""Connected components over a table of links, without gathering links or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long), in either direction. Returns node, component (the smallest node reachable) for nodes with a link.

    Each round every node joins the neighbour (or itself) whose hash of the round is the least, and links are contracted
    to what their ends have joined. Hashes are drawn anew each round, so whatever the order of the nodes about a third of
    a path's nodes are left, and rounds grow with the logarithm of their number; each round with a link left takes away a
    node at least, so there is no cap. Then the rounds' joins are followed from the first to the last.
    Links and joins are written to the shared folder after each round and one number, whether links are left, comes to
    the driver. Links of a hot node are pre-aggregated where they are read. Null ends and loops are dropped."""
    ends = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(ends.union(ends.select("b", "a")).distinct(), "links")
    joins: list[DataFrame] = []
    while not joins or both.limit(1).count():
        drawn = lambda node: F.struct(F.xxhash64(F.lit(len(joins)), node).alias("hash"), F.col(node).alias("to"))  # noqa: E731, B023
        joined = both.groupBy("a").agg(F.min(drawn("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", drawn("a"))["to"].alias("to"))
        joins.append(written(joined, "joins"))
        near, far = joins[-1].select(F.col("node").alias("a"), F.col("to").alias("x")), joins[-1].select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = written(both.join(near, "a").join(far, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        dropped(both)
        both = left
    dropped(both)
    label = joins[0]
    for j in joins[1:]:
        # what has no link left after a round isn't in the next one and keeps its place
        label = label.join(j.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    label = written(label, "labels")
    dropped(*joins)
    least = label.groupBy("to").agg(F.min("node").alias("component"))
    return label.join(least, "to").select("node", "component")
