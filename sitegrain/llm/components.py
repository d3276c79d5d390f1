"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitegrain.session import cut_lineage, forget


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node that it reaches) of each node with a link.

    Each round takes the smallest component among a node and its neighbours and then follows it once more, so that the number
    of rounds grows with the logarithm of the longest path. The rows between rounds are written to the shared folder.
    """
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    # the lower neighbours of a node are joined with the lowest of them instead: far fewer links, the same components
    lowest = links.groupBy("high").agg(F.min("low").alias("y"))
    thinned = links.join(lowest, "high").select(F.when(F.col("low") == F.col("y"), F.col("high")).otherwise(F.col("low")).alias("x"), "y")
    edges = cut_lineage(thinned.distinct())
    both = edges.union(edges.select("y", "x"))
    state = cut_lineage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        near = both.join(state.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("best"))
        step = state.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "best").alias("component"))
        after = state.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = step.join(after, "component", "left").select("node", "was", F.least("component", F.coalesce("next", "component")).alias("component"))
        seen = Observation()
        settled = cut_lineage(jumped.observe(seen, F.count(F.when(F.col("was") != F.col("component"), 1)).alias("changed")).select("node", "component"))
        forget(state)
        state = settled
        if not seen.get["changed"]:
            forget(edges)
            return state
