"""Links of the sets inside clusters of candidates, counted exactly, with work that grows with the members of a cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.arrow import group_starts, map_arrow, whole_groups, written
from pulsegrid.llm.candidates import Clusters, spread_labels
from pulsegrid.llm.components import components
from pulsegrid.llm.token_sets import fetch_sets
from pulsegrid.session import cut_lineage, in_few_tasks


def excess(difference: Column, n: Column, similarity: int) -> Column:
    """How far a set is from its cluster's pivot: two sets whose excesses add up to 0 or less are similar, whatever
    they have in common beside the pivot. (Similar is: (100 + s) * differing <= (100 - s) * both sizes.)"""
    return ((100 + similarity) * difference - (100 - similarity) * n).cast("long")


def differences(members: DataFrame, sets: DataFrame, pivots: DataFrame, similarity: int) -> DataFrame:
    """`members` with `delta`, the tokens by which a set differs from its cluster's pivot, and its `excess`."""
    named = pivots.join(sets, F.col("pivot") == F.col("rid")).select("cluster", F.col("set").alias("_of_pivot"))
    both = members.join(sets, "rid").join(named, "cluster")
    delta = F.concat(F.array_except("set", "_of_pivot"), F.array_except("_of_pivot", "set"))
    return both.withColumn("delta", delta).withColumn("excess", excess(F.size("delta"), F.col("n"), similarity)).drop("set", "_of_pivot")


def sure_links(rows: DataFrame) -> DataFrame:
    """(rid, links, root) of the links that the excesses alone decide.

    Per cluster the documents are counted by excess; a set is linked to all whose excess is at most the
    negative of its own. The counts are a table of distinct excesses, which set sizes bound, not of members.
    """
    points = rows.groupBy("cluster", "excess").agg(F.sum("copies").alias("_c"), F.min("rid").alias("_r"))
    steps = points.select("cluster", F.col("excess").alias("_at"), "_c", "_r", F.lit(0).alias("_ask"))
    asked = points.select("cluster", (-F.col("excess")).alias("_at"), F.lit(0).cast("long").alias("_c"), F.lit(None).cast("long").alias("_r"), F.lit(1).alias("_ask"))
    upto = Window.partitionBy("cluster").orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    counted = steps.unionByName(asked).withColumn("_sum", F.sum("_c").over(upto)).withColumn("_low", F.first("_r", True).over(upto)).where("_ask = 1")
    counted = counted.select("cluster", (-F.col("_at")).alias("excess"), "_sum", "_low")
    own = F.when(F.col("excess") <= 0, F.col("copies")).otherwise(F.lit(0))
    return rows.select("cluster", "rid", "copies", "excess").join(counted, ["cluster", "excess"]).select(
        "rid", (F.col("_sum") - own).alias("links"), F.coalesce("_low", "rid").alias("root")
    )


def similar(delta: list[np.ndarray], n: np.ndarray, similarity: int) -> np.ndarray:
    """Which pairs of sets, given by their differences from one set, are similar; exact, by counting common tokens."""
    size = np.array([len(d) for d in delta], dtype=np.float64)
    common = np.zeros((len(delta), len(delta)))
    tokens = np.concatenate(delta)
    if len(tokens):
        row = np.repeat(np.arange(len(delta)), size.astype(np.int64))
        _, column = np.unique(tokens, return_inverse=True)
        wide = min(max(1024, (1 << 23) // len(delta)), int(column.max()) + 1)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, int(column[-1]) + 1, wide):
            part = slice(*np.searchsorted(column, [low, low + wide]))
            held = np.zeros((len(delta), wide), dtype=np.float32)
            held[row[part], column[part] - low] = 1
            common += held @ held.T
    apart = size[:, None] + size[None, :] - 2 * common
    return (100 + similarity) * apart <= (100 - similarity) * (n[:, None] + n[None, :])


def compared_links(rows: DataFrame, similarity: int) -> DataFrame:
    """(rid, links, root) of the links that sets themselves decide, inside groups (cluster, part).

    `rows` have `left` (1 for sets whose links with the right are counted for them), `right` (1 for sets
    on the other side) and `wide` (whether a set's links are counted where it is on the left). Pairs whose
    excesses add up to 0 or less are counted elsewhere.
    """
    keys = ["cluster", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, rows=1000):
            starts = np.append(group_starts(table, keys), table.num_rows)
            rid, copies, over, n = (table.column(c).to_numpy() for c in ("rid", "copies", "excess", "n"))
            left, right, wide = (table.column(c).to_numpy().astype(bool) for c in ("left", "right", "wide"))
            lists = table.column("delta").combine_chunks()
            tokens, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            links, root = np.zeros(len(rid), dtype=np.int64), rid.copy()
            for lo, hi in zip(starts[:-1], starts[1:]):
                if hi - lo < 2:
                    continue
                linked = similar([tokens[ends[i] : ends[i + 1]] for i in range(lo, hi)], n[lo:hi].astype(np.float64), similarity)
                linked &= over[lo:hi, None] + over[None, lo:hi] > 0
                linked &= (left[lo:hi, None] & right[None, lo:hi]) & (rid[lo:hi, None] != rid[None, lo:hi])
                links[lo:hi] = np.where(left[lo:hi], linked @ copies[lo:hi], 0)
                links[lo:hi] += np.where(right[lo:hi] & ~wide[lo:hi], linked.T @ copies[lo:hi], 0)
                root[lo:hi] = rid[lo:hi][spread_labels(np.arange(hi - lo), *np.nonzero(linked))]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(links), pa.array(root)], ["rid", "links", "root"])

    dealt = rows.select(*keys, "rid", "copies", "excess", "n", "left", "right", "wide", "delta").repartition(*keys).sortWithinPartitions(*keys)
    return map_arrow(in_few_tasks(dealt), run, "rid long, links long, root long")


def in_wide_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows of large clusters, copied to the groups in which a block of wide sets (excess above 0) meets a block
    of all sets. Clusters without wide sets give none."""
    wide = (F.col("excess") > 0).cast("int")
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("_all"), F.sum(wide).alias("_wide")).where("_wide > 0")
    across = F.ceil(F.col("_all") / block)
    down = F.ceil(F.col("_wide") / block)
    placed = rows.join(sizes, "cluster").withColumns({"wide": wide, "_own": F.pmod(F.xxhash64("rid"), across), "_row": F.pmod(F.xxhash64("rid", F.lit(1)), down)})
    steps = lambda upto: F.sequence(F.lit(0).cast("long"), upto - 1)
    right = placed.withColumn("part", F.explode(F.transform(steps(down), lambda a: a * across + F.col("_own"))))
    left = placed.where("wide = 1").withColumn("part", F.explode(F.transform(steps(across), lambda b: F.col("_row") * across + b)))
    # a wide set may be on both sides of a group: it stands there once
    left = left.withColumn("right", (F.col("part") % across == F.col("_own")).cast("int")).withColumn("left", F.lit(1))
    right = right.withColumn("left", F.lit(0)).withColumn("right", F.lit(1)).where((F.col("wide") == 0) | (F.floor(F.col("part") / across) != F.col("_row")))
    return left.unionByName(right)


def exact_links(members: DataFrame, sets: DataFrame, degrees: DataFrame, similarity: int, block: int) -> DataFrame:
    """(rid, links, root): links of the sets of each cluster in any number of rows per set, all to be added up.

    Clusters of up to `block` sets are compared whole. A larger one gets a pivot, the set with most
    candidates; its sets are known by how they differ from it, which decides most pairs of a group of copies by
    counting alone. Only sets far from the pivot are compared with the others, block by block.
    """
    small = members.where(F.col("size") <= block).join(sets, "rid")
    small = small.withColumnRenamed("set", "delta").withColumns({
        "excess": F.lit(1).cast("long"), "part": F.lit(0).cast("long"), "left": F.lit(1), "right": F.lit(1), "wide": F.lit(1)})
    out = compared_links(small, similarity)
    large = cut_lineage(in_few_tasks(members.where(F.col("size") > block)))
    if large.isEmpty():
        return out
    best = large.select("cluster", "rid").join(degrees, "rid", "left")
    pivots = best.groupBy("cluster").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), -F.col("rid"))).alias("_b")).select("cluster", (-F.col("_b.col2")).alias("pivot"))
    rows = written(in_few_tasks(differences(large, sets, cut_lineage(in_few_tasks(pivots)), similarity)), "differences")
    compared = compared_links(in_wide_blocks(rows, block), similarity)
    return out.unionByName(sure_links(rows)).unionByName(compared)


def links_inside(docs: DataFrame, reps: DataFrame, found: Clusters, n: int, table: np.ndarray, similarity: int, block: int) -> DataFrame:
    """(rid, links, root) as `exact_links` gives them, of the clusters found among `reps` (rid, k1, k2, n, first_doc, copies)."""
    clusters = components(found.links).withColumnRenamed("root", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    named = reps.select(F.col("rid").alias("id"), "k1", "k2", "n", "first_doc", "copies")
    members = cut_lineage(in_few_tasks(clusters.join(sizes, "cluster").join(named, "id").withColumnRenamed("id", "rid")))
    sets = written(in_few_tasks(fetch_sets(docs, members.select("rid", "k1", "k2", "first_doc"), n, table)), "members")
    degrees = found.links.select(F.col("b").alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("degree"))
    return cut_lineage(in_few_tasks(exact_links(members.select("cluster", "size", "rid", "n", "copies"), sets, degrees, similarity, block)))
