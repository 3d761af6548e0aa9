"""Registered queries: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import chat, decontaminate, fill_middle, importance, line_dedup, linear, near_dedup, ngram_join, piece_fst, pieces, quality_model, quality_rules, sharding, token_counts, warc
from pulsegrid.llm.arrow import shared_folder
from pulsegrid.session import cut_lineage

PIECE_FILE = os.environ.get("PIECE_FILE", "/opt/tokenizers/piece_bpe_32k.model")
REGISTRY = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_line_dedup(spark, sf):
    out = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", line_dedup.kept_digest(F.col("text")).alias("kept_sha256"))


@query
def op2_warc(spark, sf):
    path = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_sentencepiece(spark, sf):
    vocabulary = pieces.load_vocabulary(PIECE_FILE)
    encoded = piece_fst.encode_pieces(table(spark, sf, "documents").select("doc_id", "text"), vocabulary)
    decoded = piece_fst.decode_pieces(encoded, vocabulary)
    # the visible space is written as a space, whatever it was before
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" "))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), same.alias("round_trip"))


@query
def op4_decontaminate(spark, sf):
    out = decontaminate.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    out = out.withColumn("n_hit", decontaminate.hit_words())
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op5_quality_rules(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality_rules.fit_rules(docs, table(spark, sf, "labels"))
    out = quality_rules.apply_rules(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


@query
def op6_chat(spark, sf):
    """All conversations and one more, -7, whose texts hold the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    read = chat.read_chats(chat.format_chats(rows.unionByName(planted))).withColumn("_loss", chat.loss_text())
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op7_ngram_join(spark, sf):
    return ngram_join.ngram_jaccard_join(table(spark, sf, "documents"))


@query
def op8_token_counts(spark, sf):
    vocabulary = pieces.load_vocabulary(PIECE_FILE)
    return token_counts.count_tokens(table(spark, sf, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "n_tokens")


@query
def op9_quality_model(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality_model.fit_quality(docs, table(spark, sf, "labels"))
    out = quality_model.score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", linear.held_out_id().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_sharding(spark, sf):
    return sharding.propagate_shards(table(spark, sf, "documents"))


@query
def op11_fill_middle(spark, sf):
    out = fill_middle.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


@query
def op12_near_dedup(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


@query
def op13_importance(spark, sf):
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("n_words")


# ---- what SQL can say of the queries whose scores or places it cannot ----

@query
def rules_base(spark, sf):
    """The columns of op5 that follow from counts."""
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return op5_quality_rules(spark, sf).select(*names)


@query
def quality_rows(spark, sf):
    """Of op9: every document, whether it is held out, and that its prediction follows from a probability."""
    follows = F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= 0.3).cast("int"))
    return op9_quality_model(spark, sf).select("doc_id", "held_out", follows.alias("follows"))


@query
def shard_facts(spark, sf):
    """Of op10: per shard its documents and the range and number of its slots; sizes and checksums of all, in all shards' rows."""
    out = cut_lineage(op10_sharding(spark, sf))
    whole = out.agg(F.sum("size").alias("sizes"), F.sum("text_crc32").alias("checksums"), F.count("grown_shard").alias("grown"), F.max("law").alias("law")).first()
    per = out.groupBy(F.col("shard").cast("long").alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("n_slots"))
    return per.select("*", *[F.lit(v).cast("string" if c == "law" else "long").alias(c) for c, v in whole.asDict().items()])


@query
def token_totals(spark, sf):
    """The tokens of op8 next to the ids of op3, per document."""
    counted = op8_token_counts(spark, sf)
    encoded = op3_sentencepiece(spark, sf).select("doc_id", F.col("n_tokens").alias("n_ids"))
    return counted.join(encoded, "doc_id").select("doc_id", (F.col("n_tokens") == F.col("n_ids")).alias("equal"))
