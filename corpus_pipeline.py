"""From raw documents to token ids: five stages over one corpus, each written before the next begins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, line_dedup, ngram_join, piece_fst, pieces, quality_model
from pulsegrid.llm.arrow import removed, shared_folder
from pulsegrid.llm.queries import PIECE_FILE

MIN_SCORE = 0.3


def _beside(docs: DataFrame, made: set[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`step(docs)` with the documents' own columns, also those that have the name of a column that `step` makes: these
    are put aside meanwhile."""
    aside, taken = {}, {c.lower() for c in docs.columns} | made
    for c in docs.columns:
        if c.lower() in made:
            name = c.lower()
            while name in taken:
                name += "_"
            taken.add(name)
            aside[c] = name
    out = step(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches MIN_SCORE; the model is fitted on the labelled ones.

    Null and empty texts are scored like any other, by what a text without words is worth; repeated rows and ties get
    equal scores; a null doc_id has no label; without labels all scores are 0.5 and all documents stay. An empty table
    stays empty, and columns of any name stay what they are.
    """
    model = quality_model.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _beside(docs, {"score_"}, lambda d: quality_model.score_quality(d, model, "score_").where(F.col("score_") >= MIN_SCORE))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; n_chars, if there, follows the text.

    A null text stays null and has 0 characters; a text may become empty, the document stays. Rows that repeat a doc_id
    are one document, one without an id loses lines that others repeat. An empty table stays empty, and columns of any
    other name stay what they are.
    """
    def step(d: DataFrame) -> DataFrame:
        out = line_dedup.dedup_lines(d)
        return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in d.columns else out

    return _beside(docs, {"n_lines", "n_dropped"}, step)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the smallest id, and if several rows share that
    id all of these.

    Rows without an id, and texts that are null, empty or without words, stay. An empty table stays empty, and
    columns of any name stay what they are.
    """
    classes = ngram_join.ngram_jaccard_join(docs)
    copies = classes.where("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.

    Null and empty texts hold none and stay; repeated rows go or stay together; an empty benchmark leaves all. An empty
    table stays empty, and columns of any name stay what they are.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    made = {"n_words", "hit_starts", "hit_ends", "hit_items"}
    return _beside(docs, made, lambda d: decontaminate.find_contamination(d, benchmark).where(F.size("hit_items") == 0))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the ids of every text, and whether decoding them gives the text back.

    Null and empty texts have no ids and come back as empty. Repeated rows, and rows without an id, are rows like others; an
    empty table gives none; other columns are left out.
    """
    vocabulary = pieces.load_vocabulary(PIECE_FILE)
    decoded = piece_fst.round_trip(docs.select("doc_id", "text"), vocabulary)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" "))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

# The first stage is a fitted model and the third a sampled join: no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage writes for itself is removed when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        with removed(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
