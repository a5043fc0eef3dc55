"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark items, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.

A stage judges rows, not ids: rows that repeat an id, or have none, are told apart by their
text (granary.llm.common.identity). A null text counts as empty in every stage. Empty tables
give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common as C
from granary.llm.decontaminate import drop_contaminated
from granary.llm.minhash import near_duplicates
from granary.llm.packing import pack_documents
from granary.llm.quality import score_quality
from granary.llm.substring_dedup import remove_repeats


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the documents (doc_id, text_hash) of `gone`."""
    doc, th = C.identity("doc_id", "text")
    gone = gone.select(F.coalesce("doc_id", F.lit(C.NO_ID)).alias("__doc"), F.col("text_hash").alias("__th")).distinct()
    return docs.withColumns({"__doc": doc, "__th": th}).join(gone, ["__doc", "__th"], "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; an empty text is judged as one, too."""
    return _without(docs, score_quality(docs, C.table(spark, sf_dir, "labels")).where("predicted = 0"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id.

    Similarity 0.8; 48 bands of 6 miss a pair there with probability 5e-7. Documents without
    an id or without words all stay; so do rows of the smallest id that share its class.
    """
    return _without(docs, near_duplicates(docs, percent=80, rows=6).where("not kept"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; n_chars counts what is left.

    A document without passages is unchanged; of one that loses all of its text the empty row
    stays. Documents without an id come first in the order that decides which is earlier.
    """
    out = remove_repeats(docs, with_row=True)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)}
    cut = F.col("n_removed") > 0
    return out.select([(F.when(cut, new[c]).otherwise(F.col("row")[c]) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, C.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; a null text is its end mark alone."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False).drop("ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("decontamination", decontamination), ("packing", packing)]

#: SQL expresses none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each through a table in the shared folder.

    A stage's own tables are removed once its result is written, its result once the next is.
    """
    scratch = C.Scratch(spark, "pipeline")
    docs = C.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        mark = len(C.Scratch.live)
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        C.Scratch.release(mark)
        if before:
            scratch.drop(before)
        before = name
    return docs
