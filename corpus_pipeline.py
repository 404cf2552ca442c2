"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`; all but the last return the columns of
documents. Stages are joined by Parquet: what one has written, the next one reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewick.llm import decontamination, minhash, packing, quality, substrings
from tidewick.llm.tables import folder, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and whose n-grams look like those of trusted texts.

    Each row is judged by its own text; a null or empty one fails (fewer than ten words). Repeated rows are judged alike,
    extra columns pass through whatever their names. An empty table gives an empty one.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    judged = quality.quality(rows, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return judged.where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Null and wordless texts and null ids are in no group and stay. Rows that repeat an id stay or go together: they go if
    every one of them has a near copy of a smaller id, so no text is lost with a copy that shares its id.
    """
    gone = minhash.near_duplicates(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of a smaller id has too; n_chars follows the text.

    Null texts stay null, with a null n_chars. A document never goes here, but its text may become short or empty.
    """
    out = substrings.cut_passages(docs, substrings.repeated_passages(docs))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; all rows of an id go with one that does, null ids stay."""
    return decontamination.clean_of(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents, placed in sequences; a null text is an empty one, repeats are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Neither hashes nor tokenizers are in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what is between them lies in the shared folder."""
    where = folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"{where}/{k}")
    return docs
