"""N-gram Jaccard join by chosen paths (Christiani, Pagh, Sivertsen: set similarity join by recursion).

Documents are sets of word n-grams. Each run sends a set to buckets named by sampled tokens; two
sets that share a token sample it together. Every bucket is first seen from one member: sets whose sketches are
alike become one cluster of candidates, once for all buckets and runs. What a bucket still holds of different
clusters is compared by sketches if the bucket is small, and split by further tokens if it is large. Links are then
counted exactly inside the clusters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.arrow import FOLDED_WORDS, lists_of, map_slices, written
from pulsegrid.llm.candidates import Clusters, sketches, sketches_alike
from pulsegrid.llm.components import components
from pulsegrid.llm.exact_links import links_inside
from pulsegrid.llm.token_sets import TokenSets
from pulsegrid.session import cut_lineage, in_few_tasks


@dataclass(frozen=True)
class Join:
    """`similarity` is the Jaccard threshold in hundredths. Sets sample `branching` / (similarity * size) of their
    tokens per level, so that two similar sets share 1 - exp(-branching) samples or more; runs are
    repeated until a pair that needs all `levels` is found with probability `recall`."""

    n: int = 5
    similarity: int = 80
    recall: float = 0.999
    branching: float = 2.0
    levels: int = 2
    small: int = 2048  # buckets up to this size are compared at once
    bins: int = 128  # bytes of a sketch
    slack: float = 0.16  # sketches estimate the similarity this far below the threshold, at worst
    set_block: int = 192  # sets compared in one group

    @property
    def runs(self) -> int:
        found = (1 - math.exp(-self.branching)) ** self.levels
        return math.ceil(math.log(1 - self.recall) / math.log(1 - found))


def samples(sets: TokenSets, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot = run * levels + level, token) of the sampled tokens."""
    share = np.minimum(join.branching / (join.similarity / 100 * np.maximum(sets.size, 1)), 1.0)
    limit = (share * float(2**63)).astype(np.uint64)[sets.doc]
    rng = np.random.default_rng(20)
    doc, slot, token = [], [], []
    for s in range(join.runs * join.levels):
        salt, factor = (int(v) for v in rng.integers(1 << 62, 1 << 63, 2))
        hit = np.flatnonzero(((sets.token ^ np.uint64(salt)) * np.uint64(factor | 1)) >> np.uint64(1) <= limit)
        doc.append(sets.doc[hit])
        token.append(sets.token[hit])
        slot.append(np.full(len(hit), s, dtype=np.int16))
    doc, slot, token = np.concatenate(doc), np.concatenate(slot), np.concatenate(token)
    order = np.argsort(doc, kind="stable")
    return doc[order], slot[order], token[order]


def set_facts(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, k1, k2, n, sketch, tokens, slots) of every document: the name of its set, the size,
    the sketch, and the tokens it samples in each run and level."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = TokenSets(batch.column("text"), join.n)
        k1, k2 = sets.names()
        doc, slot, token = samples(sets, join)
        first = np.searchsorted(doc, np.arange(len(sets.size) + 1))
        sketch = [row.tobytes() for row in sketches(sets, join.bins)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(k1), pa.array(k2), pa.array(sets.size, pa.int64()), pa.array(sketch, pa.binary()),
             lists_of(token.astype(np.int64), first, pa.int64()), lists_of(slot, first, pa.int16())],
            ["doc_id", "k1", "k2", "n", "sketch", "tokens", "slots"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), work, f"doc_id {kind}, k1 long, k2 long, n long, sketch binary, tokens array<long>, slots array<short>")


def _sampled(reps: DataFrame, join: Join, level: int) -> DataFrame:
    """(rid, run, token) of the tokens sampled at one level."""
    pairs = reps.select("rid", F.explode(F.arrays_zip("tokens", "slots")).alias("s"))
    slot = F.col("s.slots").cast("int")
    return pairs.where(slot % join.levels == level).select("rid", F.floor(slot / join.levels).alias("run"), F.col("s.tokens").alias("token"))


def clusters(reps: DataFrame, join: Join) -> Clusters:
    """The clusters of candidates of all sampled buckets."""
    def alike(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sketches_alike(n, m, x, y, join.similarity, join.slack)

    found = Clusters(reps.select("rid", "n", "sketch"), alike, join.small)
    nodes = _sampled(reps, join, 0).select(F.xxhash64("run", "token").alias("node"), "run", "rid")
    for level in range(join.levels):
        crowds = found.look(nodes, last=level == join.levels - 1)
        if crowds is None:
            break
        nodes = crowds.join(_sampled(reps, join, level + 1), ["rid", "run"]).select(F.xxhash64("node", "token").alias("node"), "run", "rid")
    return found


def ngram_jaccard_join(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, class_id, n_links): documents linked by the Jaccard similarity of their word n-grams.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; a text of fewer than n words, but
    not none, has one n-gram. `class_id` is the smallest doc_id of the documents connected by links
    (the document's own if it has none); `n_links` counts the other documents at or above the
    similarity. Documents with equal sets are one vertex with a count; pairs are never listed.

    A text without words, or null, has no links. A row without a doc_id has class_id null, no links, and
    gives none to others. Rows that repeat a doc_id count as documents. doc_ids may be of any type that has an
    order. An empty table gives none. Other columns are ignored.
    """
    facts = written(set_facts(docs, join), "sets")
    known = facts.where("n > 0 and doc_id is not null")
    named = known.groupBy("k1", "k2", "n").agg(
        F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("sketch", "tokens", "slots")]
    )
    reps = written(in_few_tasks(named).withColumn("rid", F.monotonically_increasing_id()), "reps")
    exact = links_inside(docs, reps, clusters(reps, join), join.n, FOLDED_WORDS, join.similarity, join.set_block)
    counts = exact.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(exact.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    joined = (
        reps.select("rid", "k1", "k2", "first_doc", "copies").join(counts, "rid", "left")
        .join(roots, F.col("rid") == F.col("id"), "left")
        .select("k1", "k2", "first_doc", F.coalesce("root", "rid").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    joined = cut_lineage(in_few_tasks(joined))
    lowest = cut_lineage(in_few_tasks(joined.groupBy("root").agg(F.min("first_doc").alias("class_id"))))
    classes = cut_lineage(in_few_tasks(joined.join(lowest, "root").select("k1", "k2", "class_id", "n_links")))
    linked = known.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "class_id", "n_links")
    alone = facts.where("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)
