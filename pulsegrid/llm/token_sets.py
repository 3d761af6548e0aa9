"""Sets of hashed word n-grams of texts, and how the sets of chosen documents are got again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.arrow import FOLDED_WORDS, Words, lists_of, map_slices, mix
from pulsegrid.llm.bloom import bloom_filter, known
from pulsegrid.session import cut_lineage

TOKEN_BITS = 52  # of a hashed n-gram; the rest of the word numbers the texts of a slice


class TokenSets:
    """The sets of distinct hashed n-grams of a slice of texts, in order of text and token.

    A text of fewer words, but not none, has one n-gram made of all of them.
    """

    def __init__(self, column: pa.Array, n: int, table: np.ndarray = FOLDED_WORDS):
        words = Words(column, table)
        texts = len(words.count)
        at, value = words.windows(n)
        doc = words.doc[at]
        brief = np.flatnonzero((words.count > 0) & (words.count < n))
        last = words.first[brief] + words.count[brief] - 1
        whole = np.zeros(len(brief), dtype=np.uint64)
        for j in range(n - 1):
            whole = np.where(j < words.count[brief], mix(whole ^ words.hash[np.minimum(words.first[brief] + j, last)]), whole)
        doc, value = np.concatenate([doc, brief]), np.concatenate([value, whole])
        keys = (doc.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (value >> np.uint64(64 - TOKEN_BITS))
        keys.sort()
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        self.doc = (keys >> np.uint64(TOKEN_BITS)).astype(np.int64)
        self.token = keys & np.uint64((1 << TOKEN_BITS) - 1)
        self.first = np.searchsorted(self.doc, np.arange(texts + 1))
        self.size = np.diff(self.first)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name each set, whatever the order of its tokens."""
        with np.errstate(over="ignore"):
            return tuple(
                mix(_run_sums(mix(self.token ^ np.uint64(salt)), self.first) ^ self.size.astype(np.uint64)).view(np.int64)
                for salt in (0x51ED270B, 0xA24BAED4)
            )

    def sketches(self, bins: int) -> np.ndarray:
        """One-permutation minwise sketches, a byte per bin; 0 marks an empty bin."""
        out = np.zeros((len(self.size), bins), dtype=np.uint8)
        byte = ((self.token >> np.uint64(16)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        # tokens ascend inside a text, so the last one written from the back is the smallest
        out[self.doc[::-1], (self.token % np.uint64(bins)).astype(np.int64)[::-1]] = byte[::-1]
        return out


def _run_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def fetch_sets(docs: DataFrame, wanted: DataFrame, n: int, table: np.ndarray = FOLDED_WORDS) -> DataFrame:
    """(rid, set) of the sets in `wanted` (rid, k1, k2, first_doc): their texts are read again, picked
    by a Bloom filter of the documents' ids, and only sets of picked texts are made and shuffled."""
    wanted = cut_lineage(wanted)
    hashes = wanted.select(F.xxhash64("first_doc").alias("hash"))
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(hashes, wanted.count()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        batch = batch.filter(pa.array(known(shared.value, batch.column("hash").to_numpy().view(np.uint64))))
        if not batch.num_rows:
            return None
        sets = TokenSets(batch.column("text"), n, table)
        k1, k2 = sets.names()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(k1), pa.array(k2), lists_of(sets.token.view(np.int64), sets.first, pa.int64())], ["first_doc", "k1", "k2", "set"])

    kind = wanted.schema["first_doc"].dataType
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    rows = rows.withColumn("hash", F.xxhash64("doc_id"))
    made = map_slices(rows, work, f"first_doc {kind.simpleString()}, k1 long, k2 long, set array<long>")
    return made.join(wanted, ["k1", "k2", "first_doc"]).dropDuplicates(["rid"]).select("rid", "set")
