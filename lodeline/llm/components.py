"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import dropped, written


def components(links: DataFrame, label: str = "component") -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the smallest node
    that links reach.

    Each round every node takes the smallest label among itself and its
    neighbours, and then the label of that label (pointer jumping), until
    nothing changes. Minima are pre-aggregated before they are shuffled. A hub's
    links meet its label in a join of pairs of numbers, whose large partitions
    adaptive execution splits; without it, one task gets all links of a hub.
    Rounds are written tables: a lost executor costs one round.
    """
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{label}-links")
    state = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), f"{label}-0")
    k = 0
    while True:
        k += 1
        near = both.join(state, both["b"] == state["node"]).groupBy("a").agg(F.min("component").alias("m"))
        low = state.join(near, state["node"] == near["a"], "left").select("node", "component", F.least("component", "m").alias("low"))
        of = state.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        after = written(low.join(of, F.col("low") == F.col("at"), "left").select("node", F.least("low", "beyond").alias("component"), (F.least("low", "beyond") < F.col("component")).alias("moved")), f"{label}-{k}")
        moved = after.where("moved").limit(1).count()
        dropped(state)
        state = after
        if not moved:
            dropped(both)
            out = state.select("node", "component")
            out._lodeline_path = state._lodeline_path
            return out
