"""The registered opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, fingerprints, license_scan, line_dedup, mixing, near_dedup, packing, quality, spelling, substring_dedup, toxicity, warc, whitening
from ._linear import in_fold
from ._spark import scratch_path, stored


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_definition(path: str | None = None) -> str:
    """The JSON of the tokenizer at ``path``; without one, of the public word-end BPE with 49,408 tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_definition())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sizes = stored(mixing.sized(docs, "key").drop("text"), "mix-sizes")
    return mixing.mix(sizes, key="key").select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(_read(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path, payloads=False).filter("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _classified(spark: SparkSession, sf_dir: str, module, label: str, modulus: int, remainder: int) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label")).filter(~in_fold("doc_id", modulus, remainder))
    scored = module.classify(docs, module.fit(docs, labels))
    return scored.select("doc_id", in_fold("doc_id", modulus, remainder).alias("held_out"), "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, "toxic", 4, 2)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups_of(_read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality, "quality", 3, 1)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups_of(_read(spark, sf_dir, "documents"), percent=85)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.lines_of(_read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(_read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_packing": op1_packing,
        "op2_mix_sources": op2_mix_sources,
        "op3_warc": op3_warc,
        "op4_toxicity": op4_toxicity,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_fingerprints": op6_fingerprints,
        "op7_quality": op7_quality,
        "op8_near_dedup": op8_near_dedup,
        "op9_line_dedup": op9_line_dedup,
        "op10_license_scan": op10_license_scan,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_whitening": op12_whitening,
        "op13_spelling": op13_spelling,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {"op2_mix_sources": mixing.ORACLE_SQL, "op3_warc": warc.ORACLE_SQL, "op5_exact_dedup": exact_dedup.ORACLE_SQL, "op8_near_dedup": near_dedup.ORACLE_SQL, "op9_line_dedup": line_dedup.ORACLE_SQL, "op10_license_scan": license_scan.oracle_sql(), "op11_substring_dedup": substring_dedup.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL}
