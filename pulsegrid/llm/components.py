"""Connected components of a table of links, by contraction; nothing of it reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import cut_lineage, in_few_tasks


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of `edges` (a, b); root is the smallest id of the component.

    Every id points to its smallest neighbour or itself; links are then redrawn between the ids
    pointed at, which at least halves the ids that still have links, and the pointers are composed at the end.
    Tables are checkpointed, so a hot id is a plain skewed join that AQE can split. Joins are merges: what these
    tables hold has no bound that would let one side be sent to all tasks.
    """
    live, steps = cut_lineage(in_few_tasks(_ordered(edges))), []
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        step = cut_lineage(in_few_tasks(both.groupBy(F.col("a").alias("from")).agg(F.least("from", F.min("b")).alias("to"))))
        steps.append(step)
        left = live.join(step.hint("merge"), F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
        moved = left.join(step.hint("merge"), F.col("b") == F.col("from")).select("a", F.col("to").alias("b"))
        live = cut_lineage(in_few_tasks(_ordered(moved)))
    if not steps:
        return live.select(F.col("a").alias("id"), F.col("b").alias("root"))
    roots = steps[0].select(F.col("from").alias("id"), F.col("to").alias("root"))
    for step in steps[1:]:
        roots = roots.join(step.hint("merge"), F.col("root") == F.col("from"), "left").select("id", F.coalesce("to", "root").alias("root"))
    return cut_lineage(in_few_tasks(roots)) if steps[1:] else roots
