"""Near-duplicate documents: b-bit MinHash signatures in a multi-index Hamming join, links confirmed on whole sets.

A signature is 32 values of 16 bits, in 8 chunks of 4. Two signatures that differ in at most 15 values differ, by the
pigeonhole principle, in at most one value of some chunk. Each chunk is therefore filed under its 4 keys with
one value left out: whatever the one error is, the two share a key. No pair under that distance is missed. A longer
sketch decides which of the pairs are worth comparing, and links are confirmed on whole sets.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.arrow import SPACED_FOLDED_WORDS, map_slices, mix, written
from pulsegrid.llm.candidates import Clusters, sketches, sketches_alike
from pulsegrid.llm.components import components
from pulsegrid.llm.exact_links import links_inside
from pulsegrid.llm.token_sets import TokenSets
from pulsegrid.session import cut_lineage

LANES = 4  # values of 16 bits in a chunk, which is one long
CHUNKS = 8


@dataclass(frozen=True)
class Nearness:
    """Sets of `n`-word shingles are linked at `similarity` percent."""

    n: int = 2
    similarity: int = 80
    small: int = 2048  # buckets up to this size are compared at once
    bins: int = 128  # bytes of the longer sketch
    slack: float = 0.16  # by which a sketch may estimate a linked pair below the similarity, 4.5 standard deviations
    block: int = 192  # sets compared in one group

    @property
    def radius(self) -> int:
        """The most values in which signatures may differ: one error in each chunk and, in all but one, another."""
        return 2 * CHUNKS - 1


def _minima(sets: TokenSets) -> np.ndarray:
    """32 values of 16 bits per set, as 8 longs."""
    full = np.flatnonzero(sets.size)
    out = np.zeros((len(sets.size), CHUNKS * LANES), dtype=np.uint16)
    rng = np.random.default_rng(31)
    for k in range(CHUNKS * LANES):
        salt, factor = (np.uint64(v) for v in rng.integers(1 << 62, 1 << 63, 2))
        value = (sets.token ^ salt) * (factor | np.uint64(1))
        value ^= value >> np.uint64(29)
        value *= factor ^ np.uint64(0x5DEECE66C)
        if len(full):
            out[full, k] = mix(np.minimum.reduceat(value, sets.first[full])) >> np.uint64(48)
    return out.view(np.int64)


def signatures(docs: DataFrame, plan: Nearness) -> DataFrame:
    """(doc_id, k1, k2, n, c0 .. c7, sketch): the name of each document's set, its size, the signature by chunk, and
    the whole signature with a longer sketch behind it."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = TokenSets(batch.column("text"), plan.n, SPACED_FOLDED_WORDS)
        k1, k2 = sets.names()
        chunks = _minima(sets)
        sketch = [a.tobytes() + b.tobytes() for a, b in zip(chunks, sketches(sets, plan.bins))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(k1), pa.array(k2), pa.array(sets.size, pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in chunks.T], pa.array(sketch, pa.binary())],
            ["doc_id", "k1", "k2", "n", *_CHUNK_NAMES, "sketch"])

    return map_slices(docs.select("doc_id", "text"), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n long, " + ", ".join(f"{c} long" for c in _CHUNK_NAMES) + ", sketch binary")


_CHUNK_NAMES = [f"c{i}" for i in range(CHUNKS)]


def _without(chunk: Column, lanes: tuple[int, ...]) -> Column:
    """A chunk with the values of these lanes set to zero."""
    mask = (1 << 64) - 1
    for lane in lanes:
        mask ^= 0xFFFF << (16 * lane)
    return chunk.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _keys(errors: int) -> Column:
    """(key, chunk): each chunk with `errors` of its values left out, in all ways."""
    return F.array(*[
        F.struct(F.xxhash64(F.lit(f"{i} {out}"), _without(F.col(c), out)).alias("key"), F.lit(i).alias("chunk"))
        for i, c in enumerate(_CHUNK_NAMES) for out in itertools.combinations(range(LANES), errors)
    ])


def chunk_keys() -> Column:
    """The keys of at most one error in a chunk: 32."""
    return _keys(1)


def second_keys() -> Column:
    """The keys of at most two errors in a chunk: 48."""
    return _keys(2)


def clusters(reps: DataFrame, plan: Nearness) -> Clusters:
    """The clusters of candidates. Crowds, such as a common passage makes, are dealt anew inside their bucket by a second chunk:
    of 15 errors the other 7 chunks have the rest, so that one of them has at most two."""
    def alike(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cut = 2 * CHUNKS * LANES  # the signature, then a longer sketch
        differing = (x[:, :cut].copy().view(np.uint16) != y[:, :cut].copy().view(np.uint16)).sum(axis=1)
        near = differing <= plan.radius
        near[near] = sketches_alike(n[near], m[near], x[near, cut:], y[near, cut:], plan.similarity, plan.slack)
        return near

    found = Clusters(reps.select("rid", "n", "sketch"), alike, plan.small)
    keys = reps.select("rid", F.explode(chunk_keys()).alias("k")).select(F.col("k.key").alias("node"), "rid", F.col("k.chunk").alias("chunk"))
    crowds = found.look(keys)
    if crowds is not None:
        again = crowds.join(reps.select("rid", *_CHUNK_NAMES), "rid").withColumn("k", F.explode(second_keys()))
        found.look(again.where("k.chunk <> chunk").select(F.xxhash64("node", "k.key").alias("node"), "rid"), last=True)
    return found


def near_duplicates(docs: DataFrame, plan: Nearness = Nearness()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a document's set holds its distinct runs of `n` words, or all
    its words as one if there are fewer. Documents are linked if 100 * common >= similarity * all shingles of the
    two; `component_id` is the smallest doc_id that links lead to, `kept` says that it is the document's own.
    Every link was confirmed on whole sets. One is missed only if 16 of 32 signature values differ, for
    which a pair at similarity 0.8 has a chance of 1 in 10,000, and rarer the more alike it is, or if the sketch is 4.5
    standard deviations off.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Documents with equal sets
    are one vertex. Rows that repeat a doc_id are documents of their own with one id. A row without a doc_id
    has component_id null, is kept, and links nothing. An empty table gives none. Other columns are ignored.
    """
    facts = written(signatures(docs, plan), "signatures")
    named = facts.where("n > 0 and doc_id is not null")
    firsts = [F.first(c).alias(c) for c in (*_CHUNK_NAMES, "sketch")]
    reps = named.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), *firsts)
    reps = written(reps.withColumn("rid", F.monotonically_increasing_id()), "sets-named")
    exact = links_inside(docs, reps, clusters(reps, plan), plan.n, SPACED_FOLDED_WORDS, plan.similarity, plan.block)
    roots = components(exact.select(F.col("rid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rid")
    classes = cut_lineage(reps.select("k1", "k2", "n", "rid", "first_doc").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid")))
    lowest = classes.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = cut_lineage(classes.join(lowest, "root").select("k1", "k2", "n", "component_id"))
    linked = named.join(classes, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = facts.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
