"""Clusters of candidates from buckets: what is alike is put together once, and only the rest is compared.

A bucket holds sets that may be similar. It is first seen from one member: all that are alike to it become one cluster. A
group of copies is one cluster then, in all its buckets at once, at the cost of a comparison per member. Buckets
of one cluster are done. What the others hold of different clusters is compared in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.arrow import group_starts, map_arrow, whole_groups, written
from pulsegrid.llm.token_sets import TokenSets
from pulsegrid.session import cut_lineage, in_few_tasks

BLOCK = 2048  # members of a crowd that are compared in one group, where nothing splits it any more

# sizes of both sets, sketches of both sets -> whether each pair is alike
Alike = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def sketches(sets: TokenSets, bins: int) -> np.ndarray:
    """One-permutation minwise sketches, a byte per bin; 0 marks an empty bin."""
    out = np.zeros((len(sets.size), bins), dtype=np.uint8)
    byte = ((sets.token >> np.uint64(16)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    # tokens ascend inside a text, so the last one written from the back is the smallest
    out[sets.doc[::-1], (sets.token % np.uint64(bins)).astype(np.int64)[::-1]] = byte[::-1]
    return out


def sketches_alike(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: int, slack: float) -> np.ndarray:
    """Whether sizes allow the similarity (in hundredths) and sketches come near it."""
    out = 100 * np.minimum(n, m) >= similarity * np.maximum(n, m)
    sized = np.flatnonzero(out)
    x, y = x[sized], y[sized]
    same = ((x == y) & (x != 0)).sum(axis=1)
    out[sized] = same >= (similarity / 100 - slack) * ((x | y) != 0).sum(axis=1)
    return out


def _bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """The rows (node, rid, ...) of buckets with two members at least."""
    several = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("node")
    return written(in_few_tasks(nodes.join(several, "node")), "buckets")


def mixed_nodes(nodes: DataFrame) -> DataFrame:
    """The rows of those buckets whose members have different labels yet, with a `center`: the member of the smallest
    label and number, which is the same one in most buckets of a group of copies."""
    tops = nodes.groupBy("node").agg(F.max("label").alias("_high"), F.min(F.struct("label", "rid")).alias("center"))
    tops = tops.where(F.col("center.label") < F.col("_high")).drop("_high")
    return nodes.join(tops, "node")


def parted(nodes: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Buckets in groups (node, part) of bounded size that together hold every pair of different clusters, and the
    rows of large buckets in which no cluster has half of the members.

    Members of the largest cluster of a large bucket are dealt into parts, and all others are copied to each part;
    pairs inside the cluster need no comparison.
    """
    counts = nodes.groupBy("node", "label").agg(F.count(F.lit(1)).alias("_c"))
    facts = counts.groupBy("node").agg(F.sum("_c").alias("_size"), F.max(F.struct("_c", "label")).alias("_major"))
    rows = nodes.join(facts, "node")
    fits = F.col("_size") <= small
    crowd = ~fits & (2 * F.col("_major._c") < F.col("_size"))
    parts = F.ceil(F.col("_size") / small)
    every = F.sequence(F.lit(0).cast("long"), parts - 1)
    where = F.when(fits, F.array(F.lit(0).cast("long"))).when(F.col("label") == F.col("_major.label"), F.array(F.pmod(F.xxhash64("rid"), parts))).otherwise(every)
    groups = rows.where(~crowd).select("node", "rid", "label", F.explode(where).alias("part"))
    return groups, rows.where(crowd).drop("_major")


def in_pairs_of_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of crowds, copied to each pair of blocks they take part in; crowds of one block are not copied."""
    blocks = F.ceil(F.col("_size") / block)
    own = F.pmod(F.xxhash64("rid", "node"), blocks)
    spread = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return spread.select("node", "rid", "label", (F.least("_own", "_other") * blocks + F.greatest("_own", "_other")).alias("part"))


def star_links(rows: DataFrame, facts: DataFrame, alike: Alike) -> DataFrame:
    """(a, b): the pairs (rid, center) that are alike."""
    pairs = rows.select("rid", F.col("center.rid").alias("center")).distinct().join(facts.hint("merge"), "rid")
    other = facts.select(F.col("rid").alias("center"), F.col("n").alias("m"), F.col("sketch").alias("of_center"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m, rid, center = (b.column(c).to_numpy() for c in ("n", "m", "rid", "center"))
                near = np.flatnonzero(alike(n, m, _bytes(b.column("sketch")), _bytes(b.column("of_center"))))
                yield pa.RecordBatch.from_arrays([pa.array(rid[near]), pa.array(center[near])], ["a", "b"])

    return map_arrow(in_few_tasks(pairs.join(other.hint("merge"), "center")), run, "a long, b long")


def spread_labels(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Join the groups that the links connect; `label` is each row's first row of its group."""
    while True:
        l, r = label[left], label[right]
        if np.array_equal(l, r):
            return label
        low = np.minimum(l, r)
        np.minimum.at(label, l, low)
        np.minimum.at(label, r, low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def group_links(rows: DataFrame, alike: Alike) -> DataFrame:
    """(a, b): links between the clusters of each group (node, part) that hold alike members."""
    keys = ["node", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            starts = group_starts(table, keys)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            rid, n, cluster = (table.column(c).to_numpy() for c in ("rid", "n", "label"))
            sketch = _bytes(table.column("sketch"))
            order = np.lexsort((cluster, group))  # equal clusters of a group side by side, lowest row first
            new = np.append(True, (group[order][1:] != group[order][:-1]) | (cluster[order][1:] != cluster[order][:-1]))
            label = np.zeros(len(rid), dtype=np.int64)
            label[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            first = np.flatnonzero(label == np.arange(len(rid)))
            for gap in range(1, len(rid)):
                i = np.flatnonzero(group[:-gap] == group[gap:])
                if not len(i):
                    break
                i = i[label[i] != label[i + gap]]
                j = i + gap
                near = alike(n[i], n[j], sketch[i], sketch[j])
                if near.any():
                    label = spread_labels(label, i[near], j[near])
            moved = first[label[first] != first]
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(rid[label[moved]]), pa.array(rid[moved])], ["a", "b"])

    dealt = rows.select(*keys, "rid", "label", "n", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    return map_arrow(in_few_tasks(dealt), run, "a long, b long").distinct()


@dataclass
class Clusters:
    """Clusters of the sets in `facts` (rid, n, sketch), which grow as buckets are looked at."""

    facts: DataFrame
    alike: Alike
    small: int
    links: DataFrame | None = field(default=None)  # (a, b)
    labels: DataFrame | None = field(default=None)  # (id, label) of the sets with links to smaller ones

    def labelled(self, nodes: DataFrame) -> DataFrame:
        """`nodes` with a label: sets of equal label are in one cluster, and most sets of a cluster have one label."""
        if self.labels is None:
            return nodes.withColumn("label", F.col("rid"))
        return nodes.join(self.labels.hint("merge"), F.col("rid") == F.col("id"), "left").withColumn("label", F.coalesce("label", "rid")).drop("id")

    def _add(self, links: DataFrame, relabel: bool) -> None:
        self.links = cut_lineage(in_few_tasks(links if self.links is None else links.unionByName(self.links)))
        if not relabel:
            return
        ends = self.links.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("label")).where("id <> label")
        near = ends.groupBy("id").agg(F.min("label").alias("label"))
        far = near.select(F.col("id").alias("label"), F.col("label").alias("_next"))  # two steps down
        self.labels = cut_lineage(in_few_tasks(near.join(far.hint("merge"), "label", "left").select("id", F.coalesce("_next", "label").alias("label"))))

    def look(self, buckets: DataFrame, last: bool = False) -> DataFrame | None:
        """Take in the pairs of all `buckets` (node, rid, ...), which may hold members alone. Crowds, which are large and of many clusters, are
        returned to be dealt anew, None if there are none; in the `last` look they are compared in pairs of blocks."""
        columns = buckets.columns
        if self.labels is not None:  # without labels, buckets of one member are those of one label
            buckets = shared_buckets(buckets)
        live = cut_lineage(in_few_tasks(mixed_nodes(self.labelled(buckets))))
        self._add(star_links(live.where(F.col("label") != F.col("center.label")), self.facts, self.alike), relabel=True)
        groups, crowds = parted(cut_lineage(in_few_tasks(mixed_nodes(self.labelled(live.select(*columns))).drop("center"))), self.small)
        if last:
            groups = groups.unionByName(in_pairs_of_blocks(crowds))
        self._add(group_links(groups.join(self.facts.hint("merge"), "rid"), self.alike), relabel=False)
        if last:
            return None
        crowds = cut_lineage(in_few_tasks(crowds.select(*columns)))
        return None if crowds.isEmpty() else crowds
