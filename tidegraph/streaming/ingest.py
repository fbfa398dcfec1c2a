"""Incremental ingest of transaction lines: parse, drop repeats, count by half-year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.calendar import COUNT, FIRST_YEAR, chunk_of_epoch
from tidegraph.sources import transactions


def stream_transactions(spark: SparkSession, path: str, delay: str = "30 days", max_files: int = 100) -> DataFrame:
    """A stream of parsed transactions from text files that appear in ``path``.

    Repeats of an id that arrive within ``delay`` of it (by transaction time) are dropped; the
    state kept for this is bounded by the watermark.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    parsed = transactions.parse(lines.select(F.lit(0).alias("file_seq"), F.lit(0).cast("long").alias("line_seq"), F.regexp_replace("value", "\\r$", "").alias("value")))
    timed = parsed.drop("file_seq", "line_seq").withColumn("at", F.timestamp_seconds("ts"))
    return timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["tx_id"])


def stream_chunk_counts(txs: DataFrame, first_year: int = FIRST_YEAR, count: int = COUNT) -> DataFrame:
    """Running ``(chunk_id, n_tx, n_outputs)``; at most one row of state a half-year."""
    chunk = F.coalesce(chunk_of_epoch(F.col("ts"), first_year, count), F.lit(-1)).alias("chunk_id")
    return txs.groupBy(chunk).agg(F.count(F.lit(1)).alias("n_tx"), F.sum("out_count").alias("n_outputs"))


def write_chunks(txs: DataFrame, path: str, checkpoint: str, first_year: int = FIRST_YEAR, count: int = COUNT):
    """Append the stream to Parquet by half-year, exactly once."""
    rows = txs.withColumn("chunk_id", F.coalesce(chunk_of_epoch(F.col("ts"), first_year, count), F.lit(-1))).drop("at")
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("chunk_id").trigger(availableNow=True).start()
