"""Readers for flat files: fixed-width records, degree lists, key=value reports, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _records(spark: SparkSession, path: str, width: int, kind: str, names: list[str], numbered: bool = False) -> DataFrame:
    """Little-endian records of ``width`` bytes, with their ``position`` in file order if ``numbered``; a size that does not divide is an error."""
    files = spark.read.format("binaryFile").load(path).select("length")
    if files.where(F.col("length") % width != 0).limit(1).count():
        raise ValueError(f"{path}: size is not a multiple of {width}")
    import struct

    rdd = spark.sparkContext.binaryRecords(path, width)
    rows = rdd.zipWithIndex().map(lambda x: (x[1], *struct.unpack(kind, x[0]))) if numbered else rdd.mapPartitions(lambda part: struct.iter_unpack(kind, b"".join(part)))
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.LongType()) for n in (["position"] if numbered else []) + names]))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` from 16-byte pairs of unsigned 64-bit numbers."""
    return _records(spark, path, 16, "<QQ", ["src", "dst"])


def read_vector(spark: SparkSession, path: str, name: str = "value", unset: int | None = 0xFFFFFFFF) -> DataFrame:
    """``(node_id, name)`` from unsigned 32-bit numbers by position; ``unset`` reads as null."""
    out = _records(spark, path, 4, "<I", [name], numbered=True).withColumnRenamed("position", "node_id")
    return out if unset is None else out.withColumn(name, F.when(F.col(name) != unset, F.col(name)))


def read_paired_vectors(spark: SparkSession, a: str, b: str, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``(node_id, a, b)`` from two vectors of the same nodes; vectors of different length are an error."""
    size = [spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] for path in (a, b)]
    if size[0] != size[1]:
        raise ValueError(f"{a} has {size[0]} bytes and {b} has {size[1]}")
    return read_vector(spark, a, names[0]).join(read_vector(spark, b, names[1]), "node_id")


def read_packed_dist(spark: SparkSession, path: str) -> DataFrame:
    """``(d, freq)`` from 12-byte records (unsigned 32-bit, unsigned 64-bit)."""
    return _records(spark, path, 12, "<IQ", ["d", "freq"])


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, row, value)``: text lines, whose order is that of the first three: by file name, place of the split in it, line."""
    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("row"), "value")


def read_degree_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(degree, freq)`` from one number a line, line k being degree k; blank lines do not count."""
    lines = lines_in_order(spark, path).withColumn("v", F.trim("value")).where("v <> ''")
    from tidegraph.operators.numbering import positions

    return positions(lines, ["file", "start", "row"], "degree").select("degree", F.col("v").cast("long").alias("freq"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value, int_value, float_value)`` from ``key=value`` lines; other lines are skipped."""
    parts = F.split("value", "=", 2)
    lines = spark.read.text(path).where(F.contains("value", F.lit("=")))
    out = lines.select(F.trim(F.get(parts, F.lit(0))).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("value"))
    return out.withColumns({"int_value": F.col("value").try_cast("bigint"), "float_value": F.col("value").try_cast("double")})


FIT_SCHEMA = "chunk_id int, alpha double, x_min double, L double, D double, p_value double, elapsed_time long"


def read_table(spark: SparkSession, path: str, schema: str | None = None, sep: str = "\t", header: bool = True) -> DataFrame:
    """Separated text; without a header and a schema the columns are ``column_1`` and so on."""
    reader = spark.read.option("sep", sep).option("header", header)
    if schema:
        return reader.schema(schema).csv(path)
    out = reader.csv(path)
    return out if header else out.toDF(*[f"column_{i + 1}" for i in range(len(out.columns))])


def text_to_parquet(spark: SparkSession, source: str, target: str, **how) -> None:
    """Separated text to Parquet, streamed."""
    read_table(spark, source, **how).write.mode("overwrite").parquet(target)


def read_distance_report(spark: SparkSession, path: str) -> DataFrame:
    """``(distance, diameter)`` from the first line of a report: words 3 and 5, parentheses aside."""
    words = F.split(F.trim(F.translate("value", "()\t", "   ")), " +")
    line = spark.read.text(path).limit(1)
    return line.select(F.get(words, F.lit(2)).try_cast("double").alias("distance"), F.get(words, F.lit(4)).try_cast("int").alias("diameter"))
