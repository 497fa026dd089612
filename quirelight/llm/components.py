"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import cut_lineage, in_few_tasks


def component_roots(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    Alternates two star steps until the links no longer change.  The large step points every larger
    neighbour of a node at the node's smallest neighbour, the small step the smaller ones and the
    node itself, which leaves one star a component after about log(n) rounds.  Each step is a grouped
    minimum, combined before the shuffle, and a join on the node, whose hot keys adaptive execution
    splits; no list of neighbours is ever built.  Every round is cut by a checkpoint, and runs in as many tasks
    as its links are worth.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut_lineage(edges.filter("u != v").distinct())
    rows, before = edges.count(), None
    while True:
        edges = in_few_tasks(edges, rows)
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = in_few_tasks(in_few_tasks(large.filter("u != v"), rows).distinct(), rows)
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        edges = in_few_tasks(small.select("e.u", "e.v").filter("u != v"), rows).distinct()
        edges = cut_lineage(in_few_tasks(edges, rows))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        rows, before = state[0], tuple(state)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
