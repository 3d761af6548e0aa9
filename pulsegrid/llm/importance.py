"""Importance resampling towards a target corpus, on hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.arrow import FOLDED_WORDS, Words, append_columns, map_arrow, slices, sum_by, written
from pulsegrid.llm.interning import FAR, Interned, Spans, crc32_joined


@dataclass(frozen=True)
class Resampling:
    """Runs of up to `longest` words fall into `buckets`. `draw` of 100 documents with at least `min_words`
    words are drawn; `seed` begins the hashed name that perturbs the scores."""

    longest: int = 3
    buckets: int = 10_000
    min_words: int = 20
    draw: int = 5
    seed: str = "42:"


class Features:
    """The word n-grams of a slice of texts, interned; `text` and `slot` of each occurrence."""

    def __init__(self, column: pa.Array, plan: Resampling):
        words = Words(column, FOLDED_WORDS)
        inside = words.bytes != 0
        # folded words, each followed by one space: an n-gram is then a span of bytes
        kept = inside.copy()
        kept[1:] |= inside[:-1]
        place = np.concatenate([[0], np.cumsum(kept)])
        data = words.bytes[kept]
        data[data == 0] = 32
        spans, first, last = Spans(data), place[words.start], place[words.end - 1] + 1
        word, size, doc = [], [], []
        for n in range(1, plan.longest + 1):
            at = np.flatnonzero(words.doc[: len(first) - n + 1] == words.doc[n - 1 :]) if len(first) >= n else np.zeros(0, np.int64)
            word.append(at)
            size.append(last[at + n - 1] - first[at])
            doc.append(words.doc[at])
        self.words = words.count
        self.runs = np.concatenate([[0], np.cumsum([len(d) for d in doc])])
        self.text = np.concatenate(doc)
        word, size = np.concatenate(word), np.concatenate(size)
        start, length = first[word], np.repeat(np.arange(1, plan.longest + 1), np.diff(self.runs))
        one, wide = spans.crc32(first, last - first), last - first  # of each word
        spaced = crc32_joined(np.full(len(one), crc32(b" "), dtype=np.uint32), one, np.minimum(wide, FAR - 1))

        def checks(at: np.ndarray) -> np.ndarray:
            """The checksums of n-grams put together from those of their words, unless a word is very long."""
            n, w = length[at], word[at]
            out, plain = one[w], np.ones(len(at), dtype=bool)
            for j in range(1, plan.longest):
                more = np.flatnonzero(n > j)
                next_ = w[more] + j
                plain[more] &= wide[next_] < FAR
                out[more] = crc32_joined(out[more], spaced[next_], np.minimum(wide[next_], FAR - 1) + 1)
            far = np.flatnonzero(~plain)
            out[far] = spans.crc32(start[at[far]], size[at[far]])
            return out

        self.table = Interned(spans, start, size, plan.buckets, checks)
        self.per_text = np.bincount(self.text, minlength=len(words.count))

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """The sum of the gains of each text's features: slots look up their bucket, occurrences their slot."""
        gain = gains[self.table.bucket][self.table.slot]
        total = np.zeros(len(self.words), dtype=np.int64)
        for low, high in zip(self.runs[:-1], self.runs[1:]):  # texts ascend among the n-grams of one length
            per_text = np.bincount(self.text[low:high], minlength=len(total))
            total += sum_by(gain[low:high], np.concatenate([[0], np.cumsum(per_text)]))
        return total


def bucket_counts(rows: DataFrame, plan: Resampling) -> DataFrame:
    """(bucket, n): the features of all texts in each bucket; `buckets` rows at most leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(plan.buckets, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch):
                table = Features(piece.column("text"), plan).table
                counts += np.bincount(table.bucket[table.used], weights=table.count[table.used], minlength=plan.buckets).astype(np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["bucket", "n"])

    return map_arrow(rows.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, plan: Resampling) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""

    def counts(rows: DataFrame) -> np.ndarray:
        table = bucket_counts(rows, plan).toArrow()  # at most `buckets` rows
        out = np.zeros(plan.buckets)
        out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
        return out

    s, t = counts(docs), counts(target)
    ratio = (t + 1) * (s.sum() + plan.buckets) / ((s + 1) * (t.sum() + plan.buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the hashed id: a Gumbel draw that any rerun repeats."""
    name = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, plan: Resampling = Resampling()) -> DataFrame:
    """`docs` with `n_words`, `n_features` and `weight`: how much likelier its features are in `target`."""
    shared = docs.sparkSession.sparkContext.broadcast(bucket_gains(docs, target, plan))  # `buckets` numbers

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        features = Features(batch.column("text"), plan)
        return {"n_words": pa.array(features.words, pa.int64()), "n_features": pa.array(features.per_text, pa.int64()),
                "weight": pa.array(features.weights(shared.value), pa.int64())}

    return append_columns(docs, "text", "n_words long, n_features long, weight long", work)


def ranked(rows: DataFrame, share: int) -> DataFrame:
    """`rows` (score, doc_id, ...) with `rank` 1, 2, 3 ... by falling score, then doc_id, for the floor of
    `share` in 100 rows; null for the others.

    Rows are cut by ranges of the order and written, so that the ranges stay what they are when an executor is
    lost; inside a range rows are counted, and ranges are offset by the sizes of those before (a row per
    range). Repeated rows are told apart by a number of their own, so that they split, too.
    """
    spark = rows.sparkSession
    named = written(rows.withColumn("_own", F.monotonically_increasing_id()), "scores")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_own").asc()]
    dealt = named.select("score", "doc_id", "_own").repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per range
    drawn, offsets, at = share * sum(n for _, n in sizes) // 100, [], 0
    for part, n in sizes:
        if at < drawn:
            offsets.append((part, at))
        at += n
    before = spark.createDataFrame(offsets, "_range int, _before long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranks = dealt.join(F.broadcast(before), "_range").select("_own", (F.col("_before") + inside).cast("long").alias("rank")).where(F.col("rank") <= drawn)
    return named.join(ranks, "_own", "left").drop("_own")


def resample(docs: DataFrame, target: DataFrame, plan: Resampling = Resampling()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; `rank` numbers the drawn ones.

    Features are all runs of 1 to `longest` consecutive words ([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, A-Z lower-cased),
    joined by a space, in buckets by crc32. The gain of a bucket compares its share in `target` with that in
    `docs`; `weight` sums the gains of a document, `score` adds a Gumbel draw from the id. Of the documents with
    `min_words` words, `draw` in 100 are drawn, by score, ties to the smaller doc_id.

    Null and empty texts have no features and weight 0, and are never drawn. A null id is hashed as "null" and
    comes last among ties. Rows that repeat an id count, and are drawn, each for itself, in any order among
    equal ones. An empty table gives none, an empty `target` gains that only say how common features are. Other
    columns are ignored.
    """
    scored = weigh(docs.select("doc_id", "text"), target, plan).drop("text")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), plan.seed))
    scored = written(scored, "weights")
    drawn = ranked(scored.where(F.col("n_words") >= plan.min_words), plan.draw)
    rest = scored.where(F.col("n_words") < plan.min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)
