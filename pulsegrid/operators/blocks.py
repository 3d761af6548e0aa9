"""Ordered work on recordings without putting one recording into one task.

A recording may hold a large share of all rows, so no operator here sorts raw rows per record.
Rows are cut into blocks of bounded length along the order column; the shuffle key is
(record, block). What crosses block borders travels in two ways:

* per-record facts (offsets, first values, bounds) are worked out on the block table, which has
  one row per block and is built with map-side aggregation, then joined back on (record, block);
* neighbouring rows are copied into the blocks whose frames reach them (`with_halo`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 16_384
# Rows without a time are a block of their own, before all others; no time lies there.
NO_TIME = -(1 << 62)


def block_of(c: Column | str, size: int = BLOCK) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(size))


def time_block(c: Column | str, size: int = BLOCK) -> Column:
    """The block of a time that may be null: rows without one come first in their record."""
    return F.coalesce(block_of(c, size), F.lit(NO_TIME))


def task_count(spark: SparkSession) -> int:
    """Tasks to use where a small table unfolds into many rows: AQE would merge by bytes and leave
    the unfolding to a few tasks, so the number is given explicitly."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(first or 0))


def attach_record_stats(
    df: DataFrame,
    keys: list[str],
    block: str,
    partial: dict[str, Column],
    final: Callable[[WindowSpec, WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Join per-record statistics onto every row, with (record, block) as the join key.

    `partial` are aggregates per block; `final` receives the window over a record's blocks
    (unordered, ordered) and names the columns to attach.
    """
    parts = df.groupBy(*keys, block).agg(*[c.alias(n) for n, c in partial.items()])
    whole = Window.partitionBy(*keys)
    wanted = final(whole, whole.orderBy(block))
    stats = parts.select(*keys, block, *[c.alias(n) for n, c in wanted.items()])
    return df.join(stats, [*keys, block])


def join_spread(
    df: DataFrame, table: DataFrame, on: list[str], along: str, keys: list[str], how: str = "inner",
    size: int = BLOCK,
) -> DataFrame:
    """Join a table with one row per record or group onto rows without shuffling rows by record.

    The table is joined onto the distinct (record, block) cells, one row per block, and the cells
    onto the rows; `along` is the column blocks are cut along.
    """
    blocked = df.withColumn("_cell", time_block(along, size))
    cells = blocked.select(*keys, "_cell").distinct().join(table, on, how)
    return blocked.join(cells, [*keys, "_cell"], how).drop("_cell")


def with_position(
    df: DataFrame, keys: list[str], order: list[str], block: str, name: str = "idx"
) -> DataFrame:
    """0-based position of a row in its record: offset of the block + rank inside the block.

    `order` must be unique per record, and `block` monotone in it and not null (`time_block`).
    """
    placed = attach_record_stats(
        df, keys, block,
        {"_n": F.count(F.lit(1))},
        lambda whole, ordered: {
            "_before": F.coalesce(
                F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            )
        },
    )
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    return placed.withColumn(name, F.col("_before") + F.row_number().over(inside) - 1).drop("_before")


def with_halo(
    df: DataFrame, pos: str, before: int = 0, after: int = 0, size: int = BLOCK
) -> DataFrame:
    """Give every row to each block whose frames reach it.

    A frame reaches `before` steps back and `after` steps ahead of its own row. Adds `_block` and
    `_own` (true for the one copy that lives in its home block; keep only those afterwards).
    """
    p = F.col(pos)
    reach = F.sequence(block_of(p - after, size), block_of(p + before, size))
    return df.withColumn("_block", F.explode(reach)).withColumn(
        "_own", F.col("_block") == block_of(p, size)
    )


def global_rank(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """0-based rank of distinct values of `col` in their sort order, without a one-task sort.

    Range partitioning sorts by sampled bounds; the result is checkpointed so that the partition
    numbers used for the offsets are the ones the rows really have.
    """
    from pulsegrid.session import cut_lineage

    tasks = task_count(df.sparkSession)
    ranged = cut_lineage(
        df.select(col).distinct()
        .repartitionByRange(tasks, col)
        .withColumn("_part", F.spark_partition_id())
    )
    # at most one row per shuffle partition, whatever the number of values
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(col)
    return ranged.join(F.broadcast(offsets), "_part").select(
        col, (F.col("_before") + F.row_number().over(inside) - 1).alias(name)
    )
