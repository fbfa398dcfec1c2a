"""Half-year chunks: the calendar, and the chunk of a moment without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reference period: 28 half-years from 2009 on.
FIRST_YEAR, COUNT = 2009, 28


def half_years(spark: SparkSession, first_year: int = FIRST_YEAR, count: int = COUNT) -> DataFrame:
    """``(chunk_id, start_date, end_date)``: half-open half-years, UTC; end_date is the last second."""
    first = F.lit(f"{first_year}-01-01 00:00:00").cast("timestamp")
    last = F.lit(f"{first_year + (count - 1) // 2}-{'01' if count % 2 else '07'}-01 00:00:00").cast("timestamp")
    starts = spark.range(1).select(F.posexplode(F.sequence(first, last, F.expr("interval 6 months"))).alias("i", "start_date"))
    return starts.select(
        (F.col("i") + 1).alias("chunk_id"), "start_date", (F.col("start_date") + F.expr("interval 6 months") - F.expr("interval 1 second")).alias("end_date")
    )


def chunk_of(moment: Column, first_year: int = FIRST_YEAR, count: int = COUNT) -> Column:
    """The 1-based half-year of a timestamp, null outside the calendar; arithmetic only."""
    k = (F.year(moment) - first_year) * 2 + F.when(F.month(moment) <= 6, 1).otherwise(2)
    return F.when((k >= 1) & (k <= count), k).cast("int")


def chunk_of_epoch(seconds: Column, first_year: int = FIRST_YEAR, count: int = COUNT) -> Column:
    return chunk_of(F.timestamp_seconds(seconds), first_year, count)


def label(chunk: Column, first_year: int = FIRST_YEAR) -> Column:
    """``2009-H1`` and so on."""
    return F.format_string("%d-H%d", F.lit(first_year) + F.floor((chunk - 1) / 2).cast("int"), F.pmod(chunk - 1, F.lit(2)) + 1)


def monotone_chunks(rows: DataFrame, seq: str, chunk: str) -> DataFrame:
    """The cursor variant for nearly sorted input: a late row falls in the chunk reached so far,
    and rows from the first one beyond the calendar on are cut off.

    ``chunk`` must be null only beyond the calendar.  The running maximum is taken per
    range of ``seq`` and continued over the ranges, so no task sees all rows.
    """
    from tidegraph.operators.numbering import running

    order = F.coalesce(F.col(chunk), F.lit(1 << 30))
    out = running(rows.withColumn("_k", order), [seq], "_k", "_m", "max")
    return out.where(F.col("_m") < (1 << 30)).withColumn(chunk, F.col("_m").cast("int")).drop("_k", "_m")
