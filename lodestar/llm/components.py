"""Connected components of an edge table by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def connected_components(edges: DataFrame, tables: scratch.Tables) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long): root is the smallest node that its links reach.

    Each round takes the smallest root among a node's neighbours for the node *and for its present root*, then jumps to the root's
    root, so the number of rounds grows with the logarithm of the longest chain.  Every round is written to shared scratch; nothing
    but a count comes to the driver.  A round that changes nothing ends the loop: labels only fall, so it always comes.  ``tables`` gets the
    result."""
    both = scratch.persist_table(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = scratch.persist_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        near = both.join(of_b, "b").groupBy("a").agg(F.min("rb").alias("m"))
        seen = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "m").alias("m"))
        hook = seen.select(F.col("node"), F.col("m")).union(seen.select(F.col("root").alias("node"), F.col("m"))).groupBy("node").agg(F.min("m").alias("m"))
        up = hook.select(F.col("node").alias("m"), F.col("m").alias("up"))
        jumped = hook.join(up, "m", "left").select("node", F.least("m", F.coalesce("up", "m")).alias("root"))
        new = scratch.persist_table(jumped, "labels")
        moved = new.withColumnRenamed("root", "r2").join(labels, "node").where("r2 <> root").limit(1).count()
        scratch.drop_table(labels)
        labels = new
        if not moved:
            break
    scratch.drop_table(both)
    return tables.own(labels)
