"""Writers.  All overwrite unless told to append, so a rerun gives the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet by chunk; edges sorted by (src, dst) inside, which packs well."""
    nodes.write.mode("overwrite").partitionBy("chunk_id").parquet(f"{path}/nodes")
    by = edges.repartition("chunk_id", F.pmod(F.xxhash64("src"), F.lit(16))).sortWithinPartitions("chunk_id", "src", "dst")
    by.write.mode("overwrite").option("compression", "zstd").partitionBy("chunk_id").parquet(f"{path}/edges")


def write_chunked_text(lines: DataFrame, path: str) -> None:
    """``(chunk_id, value)`` as one text folder per chunk."""
    lines.select("chunk_id", "value").write.mode("overwrite").partitionBy("chunk_id").text(path)


def write_parquet_zstd(df: DataFrame, path: str, level: int = 12) -> None:
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)


def write_components(labels: DataFrame, path: str) -> None:
    """Component ids as text, one a line, in node order."""
    labels.orderBy("node_id").select(F.col("comp_id").cast("string").alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``mode="append"`` adds the rows to those of earlier runs."""
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_degree_counts(dist: DataFrame, path: str) -> None:
    """``(degree, freq)`` as one number a line, line k being degree k; degrees without nodes are 0."""
    top = dist.agg(F.max("degree").cast("long").alias("top"))
    every = top.where("top IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("degree"))
    lines = every.join(dist.select(F.col("degree").cast("long").alias("degree"), "freq"), "degree", "left")
    lines.orderBy("degree").select(F.coalesce("freq", F.lit(0)).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_stats(row: DataFrame, path: str) -> None:
    """One row as ``key=value`` lines."""
    pairs = F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in row.columns])
    row.select(F.explode(pairs).alias("value")).write.mode("overwrite").text(path)


def with_empty_chunks(dist: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every chunk of the calendar appears, with nulls where it has no rows."""
    return calendar.select("chunk_id").join(dist, "chunk_id", "left")
