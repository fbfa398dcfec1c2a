"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes all rows its predecessor kept, as Parquet, and its decisions take
effect: quality rules drop documents, line dedup shortens them, near-dedup keeps the
smallest ``doc_id`` of each group, decontamination drops documents that hold a benchmark
item, and the last stage turns what is left into token ids.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.llm import decontaminate, line_dedup, minhash, pieces, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    used = ("text", "lang", "source")
    rest = [c for c in docs.columns if c not in used]  # whatever they are called, they go through as they are
    kept = quality.judged(docs.select(*used, F.struct(*rest).alias("_rest"))).where("kept")
    return kept.select(*[F.col(c) if c in used else F.col("_rest")[c].alias(c) for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one holds; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of smallest ``doc_id``."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = scratch.materialize(gone, "gone")
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g._gone"), "left_anti").select("d.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)``."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither near-duplicate components nor the encoding; tests/llm has a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
