"""The corpus pipeline: quality filter, exact dedup, near dedup, source mixing, packing.

Counted as part of the subpackage ``tallyforge.llm``. Each stage takes (spark, docs, sf_dir); its result is written as
Parquet and read back as the next stage's ``docs``. All but the last return the columns of ``docs``, whatever they are
called: stages work on the columns doc_id, text and source under names that clash with no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm import exact_dedup, mixing, near_dedup, packing, quality
from tallyforge.llm._linear import in_fold
from tallyforge.llm._spark import free, stored
from tallyforge.llm.queries import tokenizer_definition


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter(~in_fold("doc_id", 3, 1))
    return docs.filter(quality.score_column(quality.fit(docs, labels)) >= quality.THRESHOLD)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep(docs).select(docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, similar by 0.8 or more, the document with the smallest doc_id stays."""
    return near_dedup.keep(docs, percent=80).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; the last text of a source's budget ends with its exact word."""
    own = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    packed, epoch = free(docs, "others", "epoch")
    others = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in own]) if own else F.lit(None).cast("int")
    rows = mixing.repeated(mixing.mix(docs.select("doc_id", "text", "source", others.alias(packed))), epoch)
    return rows.select([F.col(packed).getField(c).alias(c) if c in own else F.col(c) for c in docs.columns])


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences with their token ids, neighbours by BM25 side by side, a document's repeats apart."""
    pieces = packing.pack(docs, tokenizer_definition())
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "seed_doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("near_dedup", near_deduplication),
    ("mix_sources", source_mixing),
    ("packing", sequence_packing),
]

#: A trained classifier and a greedy fill are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
