"""Group-aware, class-balanced folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.blocks import global_rank, join_spread
from pulsegrid.schema import KEYS, LABEL
from pulsegrid.session import cut_lineage


def group_class_counts(df: DataFrame, group: str = "grp", label: str = LABEL) -> DataFrame:
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("bigint")).alias("n_pos")
    )


def dealt_folds(counts: DataFrame, k: int, group: str = "grp", name: str = "fold") -> DataFrame:
    """Group -> fold from (group, n, n_pos), by one rule at every size.

    Groups in order of positives, then rows (both falling), then name are dealt back and forth:
    0 1 .. k-1, k-1 .. 1 0, and so on. Ranks come from range partitioning, so no task and no driver sees all
    groups.
    """
    order = F.struct((-F.col("n_pos")).alias("p"), (-F.col("n")).alias("n"), F.col(group).alias("g"))
    ranks = global_rank(counts.select(order.alias("_order")), "_order", "_rank")
    turn = F.pmod("_rank", F.lit(2 * k))
    return ranks.select(
        F.col("_order.g").alias(group), F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias(name)
    )


def fold_totals(placed: DataFrame, k: int, name: str = "fold") -> tuple[list[int], list[int]]:
    """(rows, positives) of each fold, from (group, n, n_pos, fold); k rows reach the driver."""
    found = {r[name]: r for r in placed.groupBy(name).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos")).collect()}
    return [found[f]["n"] if f in found else 0 for f in range(k)], [found[f]["n_pos"] if f in found else 0 for f in range(k)]


def _spread(totals: list[int]) -> int:
    return max(totals) - min(totals)


def _swaps(placed: DataFrame, want: list[tuple[int, int, int]], what: str, other: str, group: str, name: str) -> DataFrame:
    """(high, low, group_high, group_low, d, e): per pair of folds the two groups whose exchange moves nearest to the
    wanted amount of `what` from the high fold to the low one, and least of `other`.

    A fold shows, for each amount of `what`, its groups with least and most of `other`; the two sides meet on the amount
    that would be exact, or up to 8 away from it.
    """
    spark = placed.sparkSession
    ends = placed.groupBy(name, what).agg(F.min(F.struct(other, group)).alias("a"), F.max(F.struct(other, group)).alias("b"))
    shown = ends.select(name, what, F.explode(F.array("a", "b")).alias("g")).select(name, what, F.col(f"g.{other}").alias("o"), F.col(f"g.{group}").alias("g")).distinct()
    pairs = spark.createDataFrame([(h, l, d, e) for h, l, d in want for e in range(max(1, d - 8), min(2 * d, d + 9))], "high int, low int, wish long, d long")
    high = shown.join(F.broadcast(pairs), F.col(name) == F.col("high"))  # k / 2 x 17 rows
    high = high.select("high", "low", "wish", "d", (F.col(what) - F.col("d")).alias("meets"), F.col("o").alias("o_high"), F.col("g").alias("group_high"))
    low = shown.select(F.col(name).alias("low"), F.col(what).alias("meets"), F.col("o").alias("o_low"), F.col("g").alias("group_low"))
    found = high.join(low, ["low", "meets"]).withColumn("e", F.col("o_high") - F.col("o_low"))
    best = F.min(F.struct(F.abs(F.col("d") - F.col("wish")).alias("far"), F.abs("e").alias("side"), "group_high", "group_low", "d", "e")).alias("b")
    return found.groupBy("high", "low").agg(best).select("high", "low", "b.group_high", "b.group_low", "b.d", "b.e")


def balanced_folds(counts: DataFrame, k: int, group: str = "grp", name: str = "fold", rounds: int = 40) -> DataFrame:
    """Group -> fold as `dealt_folds`, then evened out by exchanges of two groups between two folds.

    In each round the folds are paired, most with least: by positives as long as that helps, then by rows. Each pair
    exchanges the two groups that come nearest to evening it out. An exchange is taken only if neither the spread of
    positives nor that of rows gets larger and the pair's own difference gets smaller, so that rounds come to an end. What
    reaches the driver in a round is a row per fold and per pair.
    """
    placed = cut_lineage(counts.join(dealt_folds(counts, k, group, name), group).select(group, "n", "n_pos", name))
    what, other = "n_pos", "n"
    for _ in range(rounds):
        totals = dict(zip(("n", "n_pos"), fold_totals(placed, k, name)))
        order = sorted(range(k), key=lambda f: (totals[what][f], totals[other][f], f))
        want = [(h, l, (totals[what][h] - totals[what][l]) // 2) for l, h in zip(order[: k // 2], reversed(order))]
        want = [w for w in want if w[2] > 0]
        taken = []
        limit = {c: (min(totals[c]), max(totals[c])) for c in totals}
        for r in _swaps(placed, want, what, other, group, name).collect() if want else []:  # a row per pair of folds
            after = {what: (totals[what][r["high"]] - r["d"], totals[what][r["low"]] + r["d"]), other: (totals[other][r["high"]] - r["e"], totals[other][r["low"]] + r["e"])}
            if all(limit[c][0] <= v <= limit[c][1] for c in after for v in after[c]):
                taken += [(r["group_high"], r["low"]), (r["group_low"], r["high"])]
        if taken:
            moved = placed.sparkSession.createDataFrame(taken, f"{group} {dict(placed.dtypes)[group]}, _to int")  # two rows per pair
            placed = cut_lineage(placed.join(F.broadcast(moved), group, "left").withColumn(name, F.coalesce("_to", name)).drop("_to"))
        elif what == "n_pos":
            what, other = "n", "n_pos"
        else:
            break
    return placed.select(group, name)


def assign_folds(
    df: DataFrame, k: int, name: str = "fold", group: str = "grp", label: str = LABEL,
    along: str = "idx", keys: list[str] = KEYS, counts: DataFrame | None = None, balance: bool = False,
) -> DataFrame:
    """Adds the fold number 0..k-1; no group is in two folds and every row is in one.

    `counts` are the class counts of the groups where they are known already. `balance` evens the dealt folds out.
    """
    rule = balanced_folds if balance else dealt_folds
    table = rule(group_class_counts(df, group, label) if counts is None else counts, k, group, name)
    return join_spread(df, table, [group], along, keys)
