"""Line dedup: two Bloom filters over all lines, then an exact check of the suspected repeats alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.arrow import append_columns, flat_bytes, map_arrow, map_slices, slices, written
from pulsegrid.llm.bloom import KEY_BITS, MOST_WORDS, Twice, bloom_filter, known
from pulsegrid.session import cut_lineage

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONTINUATION = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # lower() of bytes folds A-Z only


def long_keys(text: bytes, min_chars: int) -> set[bytes]:
    keys = (line_key(line) for line in text.split(b"\n") if len(line) >= min_chars)
    return {k for k in keys if len(k) >= min_chars and len(k.translate(None, _CONTINUATION)) >= min_chars}


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    raw, offsets = flat_bytes(batch.column("text"))
    raw = raw.tobytes()
    return (raw[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


def _hashes(batch: pa.RecordBatch, min_chars: int) -> np.ndarray:
    """The hashes of the long keys of each text, each once for a text."""
    return np.array([xxhash.xxh3_64_intdigest(k) for text in _texts(batch) for k in long_keys(text, min_chars)], dtype=np.uint64)


def ranges_of(docs: DataFrame, range_bytes: int) -> int:
    """As many ranges of hashes as the input needs, by its size; as many as a shuffle has if that is not known."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(least, min(-(-size // range_bytes), 100_000))


def seen_twice(docs: DataFrame, min_chars: int, range_bytes: int) -> DataFrame:
    """(hash) of the keys that two texts hold, and a few by chance: hashes are dealt by range, and each
    range is streamed through its own pair of filters, whose number grows with what the range holds."""
    words = max(1 << 10, range_bytes // 16 // 8)  # four bits for each byte of input, to begin with

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found, counts = np.unique(_hashes(piece, min_chars), return_counts=True)
                found = np.concatenate([found, found[counts > 1]])  # twice here: two rows are enough
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["hash"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Twice(words)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(filters.add(batch.column("hash").to_numpy().view(np.uint64)).view(np.int64))], ["hash"])

    rows = map_arrow(docs.select("text"), hashes, "hash long")
    return map_arrow(rows.repartition(ranges_of(docs, range_bytes), "hash"), again, "hash long")


def suspected(docs: DataFrame, twice: DataFrame, min_chars: int, most: int) -> DataFrame:
    """(doc_id, mark, key) of the long keys whose hashes are in `twice`, and a few by chance; one row for a text and key.

    `mark` is a hash of the text. A filter of the hashes is sent to all tasks; if they are more than `most`, it is done in
    rounds, each with the hashes of one range and a pass over the texts.
    """
    count = twice.count()
    rounds = max(1, -(-count // most))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    out = None
    for turn in range(rounds):
        mine = twice if rounds == 1 else twice.where(F.pmod("hash", F.lit(rounds)) == turn)
        shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(mine, -(-count // rounds)))

        def work(batch: pa.RecordBatch, turn: int = turn, shared=shared) -> pa.RecordBatch | None:
            found = [(i, k) for i, text in enumerate(_texts(batch)) for k in long_keys(text, min_chars)]
            if not found:
                return None
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for _, k in found], dtype=np.uint64)
            hit = np.flatnonzero(known(shared.value, hashes) & (hashes.view(np.int64) % rounds == turn))
            at = pa.array([found[h][0] for h in hit], pa.int64())
            keys = pa.array([found[h][1].decode("utf-8", "replace") for h in hit], pa.string())
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("mark").take(at), keys], ["doc_id", "mark", "key"])

        part = map_slices(rows, work, f"doc_id {kind}, mark long, key string")
        out = part if out is None else out.unionByName(part)
    return out


def fresh_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, range_bytes: int = 128 << 20, most: int = MOST_WORDS * 64 // KEY_BITS) -> DataFrame:
    """Drop lines that repeat across documents; adds `n_lines` (before) and `n_dropped`, replaces `text`.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at
    least `min_chars` code points found in at least `min_docs` doc_ids loses all its lines but
    those of the largest doc_id holding it. One pass sends the hash of each key to the once-seen and
    twice-seen Bloom filters of its range of hashes, `range_bytes` of input for each range at first; a second finds the
    keys whose hashes were seen twice, and only these are shuffled as text, counted exactly and resolved. Only
    documents that lose lines are shuffled; the others are taken from a scan of their own.

    Null text: one empty line, and the text stays null. Rows that repeat a doc_id are one document.
    A document without an id does not count, and loses lines that others repeat. An empty table stays
    empty. Columns called n_lines or n_dropped are replaced, others kept, whatever they are called.
    """
    twice = cut_lineage(seen_twice(docs, min_chars, range_bytes))
    suspects = written(suspected(docs, twice, min_chars, most), "suspects")
    repeated = cut_lineage(
        suspects.groupBy("key").agg(F.countDistinct("doc_id").alias("_n"), F.max("doc_id").alias("_keeper"))
        .where(F.col("_n") >= min_docs).drop("_n")
    )
    mark, gone, owner, note, touched = fresh_names(docs, "mark", "gone", "owner", "note", "touched")
    lost = suspects.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
    lost = cut_lineage(lost.groupBy(F.col("doc_id").alias(owner), F.col("mark").alias(note)).agg(F.collect_set("key").alias(gone)))  # the lines of one text
    ids = lost.select(F.xxhash64(owner, note).alias("hash"))
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(ids, lost.count()))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*kept).withColumn(mark, F.xxhash64("text")).withColumn(touched, F.xxhash64("doc_id", mark))

    def only(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                may = known(shared.value, batch.column(touched).to_numpy().view(np.uint64))
                yield batch.filter(pa.array(may == hit))

        return map_arrow(rows, run, rows.schema)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, before, dropped = [], [], []
        nulls = batch.column("text").is_null().to_pylist()
        gones = batch.column(batch.schema.names.index(gone))
        for i, text in enumerate(_texts(batch)):
            lines = text.split(b"\n")
            keep = lines
            if gones[i].is_valid:
                bad = {k.encode() for k in gones[i].as_py()}
                keep = [line for line in lines if line_key(line) not in bad]
            before.append(len(lines))
            dropped.append(len(lines) - len(keep))
            texts.append(None if nulls[i] else (text if keep is lines else b"\n".join(keep)).decode("utf-8", "replace"))
        return {"text": pa.array(texts, pa.string()), "n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}

    same = F.col("doc_id").eqNullSafe(F.col(owner)) & F.col(mark).eqNullSafe(F.col(note))
    joined = only(True).join(lost, same, "left").drop(owner, note)
    order = [*kept, "n_lines", "n_dropped"]
    changed = append_columns(joined, "text", "text string, n_lines long, n_dropped long", work).select(*order)
    lines = F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")) + 1, F.lit(1)).cast("long")
    whole = only(False).select(*kept, lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return changed.unionByName(whole)


def kept_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
