"""Training rows and hashed n-gram features shared by the two linear quality models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.arrow import SPACED_WORDS, Words, byte_table, lists_of, map_arrow, map_slices, mix

# Letters and digits, against punctuation: "the***" is the word "the" and the word "***".
KINDS = byte_table(lambda b: True, lambda b: 1 if b >= 128 or chr(b).isalnum() else 2)


def held_out_id(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the ids that no model may learn from: crc32(id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `max_rows` labelled documents outside the held-out fifth.

    The sample is the ids of smallest hash, so it does not depend on the partitions. Rows without
    an id or a label do not count; of several labels of an id the mean decides (at least a half is
    1), of several texts the smallest is taken.
    """
    ids = (
        labels.select("doc_id", F.col(label).alias("_label"))
        .where(F.col("doc_id").isNotNull() & F.col("_label").isNotNull() & ~held_out_id())
        .groupBy("doc_id").agg((F.avg("_label") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # max_rows rows at most
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def repeats(words: Words, n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each n-gram with its words renamed: which of them are equal, whatever they are."""
    size = max(0, len(words.hash) - n + 1)
    same = words.doc[:size] == words.doc[n - 1 :] if size else np.zeros(0, dtype=bool)
    shape, bit = np.zeros(size, dtype=np.uint64), 0
    for i in range(n):
        for j in range(i + 1, n):
            shape |= (words.hash[i : i + size] == words.hash[j : j + size]).astype(np.uint64) << np.uint64(bit)
            bit += 1
    return words.doc[:size][same], mix(shape[same])


def ngram_indices(words: Words, bits: int, sizes: list[int], characters: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram (text of each n-gram, in order; its hashed index)."""
    out = []
    for n in sizes:
        at, value = words.windows(n)
        out.append((words.doc[at], value))
    out += [words.characters(n) for n in characters]
    out.append(repeats(words))
    return [(doc, (value + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)) for k, (doc, value) in enumerate(out)]


def tokens(column: pa.Array) -> Words:
    return Words(column, SPACED_WORDS, KINDS)


def mean_weights(words: Words, weights: np.ndarray, bits: int, sizes: list[int], characters: list[int]) -> np.ndarray:
    """Per text, for each kind of n-gram the mean weight of its n-grams, summed over the kinds."""
    n = len(words.count)
    total = np.zeros(n)
    for doc, index in ngram_indices(words, bits, sizes, characters):
        total += np.bincount(doc, weights[index], n) / np.maximum(np.bincount(doc, minlength=n), 1)
    return total


def features(rows: DataFrame, bits: int, sizes: list[int], characters: list[int]) -> DataFrame:
    """(doc_id, y, idx, val): the sparse vector whose product with weights is `mean_weights`."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = tokens(batch.column("text"))
        n = len(words.count)
        keys, values = [], []
        for doc, index in ngram_indices(words, bits, sizes, characters):
            key, count = np.unique((doc.astype(np.uint64) << np.uint64(bits)) | index, return_counts=True)
            share = 1.0 / np.maximum(np.bincount(doc, minlength=n), 1)
            keys.append(key)
            values.append(count * share[(key >> np.uint64(bits)).astype(np.int64)])
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        value = np.bincount(inverse, np.concatenate(values), len(key))
        first = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(bits))
        index = (key & np.uint64((1 << bits) - 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), lists_of(index, first, pa.int32()),
             lists_of(value.astype(np.float32), first, pa.float32())], ["doc_id", "y", "idx", "val"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_slices(rows, work, f"doc_id {kind}, y int, idx array<int>, val array<float>")


def fit_in_one_task(rows: DataFrame, fit: Callable[[list], np.ndarray]) -> np.ndarray:
    """Run `fit` over a bounded sample, ordered by id, in one task; only the weights come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = []
        for batch in batches:
            for doc, y, idx, val in zip(*(batch.column(c) for c in ("doc_id", "y", "idx", "val"))):
                sample.append((doc.as_py(), y.as_py(), idx.values.to_numpy(), val.values.to_numpy()))
        sample.sort(key=lambda row: row[0])
        order = np.random.default_rng(7).permutation(len(sample))  # neighbours in id may share a source
        weights = fit([sample[i][1:] for i in order])
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary())], ["w"])

    row = map_arrow(rows.repartition(1), run, "w binary").first()
    return np.frombuffer(bytes(row["w"]), dtype="<f8")


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
