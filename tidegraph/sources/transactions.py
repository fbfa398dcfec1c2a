"""The transaction list: ``info:inputs:outputs`` lines, and rendering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.numbering import positions
from tidegraph.sources.files import lines_in_order


#: Bytes of a line at most.
LONGEST = 64 << 20


def read_lines(spark: SparkSession, paths: list[str], longest: int = LONGEST) -> DataFrame:
    """``(file_seq, line_seq, value)``: lines of files in the order given, without ``\\r``; files are never joined.

    The files of a folder follow each other by name.  A line of more than ``longest`` bytes fails at run time.
    """
    out = None
    for i, path in enumerate(paths):
        one = lines_in_order(spark, path).select(F.lit(i).alias("file_seq"), F.struct("file", "start", "row").alias("line_seq"), F.regexp_replace("value", "\\r$", "").alias("value"))
        out = one if out is None else out.unionByName(one)
    size = F.octet_length("value")
    fail = F.raise_error(F.format_string("a line of %d bytes in %s", size, "line_seq.file")).cast("string")
    return out.withColumn("value", F.when(size > longest, fail).otherwise(F.col("value")))


def _prefix_int(text: Column) -> Column:
    """Leading digits with an optional sign as a number; 0 where there are none."""
    return F.coalesce(F.regexp_extract(text, r"^([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def count_fields(section: Column) -> Column:
    """``;``-separated fields, without trailing empty ones; 0 for an empty section."""
    cut = F.regexp_replace(section, ";+$", "")
    return F.when(cut == "", 0).otherwise(F.size(F.split(cut, ";", -1)))


def parse(lines: DataFrame, lenient: bool = True) -> DataFrame:
    """``(file_seq, line_seq, ts, block_id, tx_id, inputs, out_count)`` of well-formed lines.

    Lines without two colons and lines of negative id go; with ``lenient=False`` so do lines
    with fewer than three info fields (their id reads as 0 otherwise).
    """
    sections = F.split("value", ":", -1)
    cut = lines.where(F.size(sections) >= 3).select("*", sections.alias("s")).select("*", F.split(F.get("s", F.lit(0)), ",", -1).alias("info"))
    field = lambda a, i: F.coalesce(F.get(a, F.lit(i)), F.lit(""))
    ins = F.filter(F.split(F.get("s", F.lit(1)), ";", -1), lambda x: x != "")
    record = lambda x: F.struct(
        _prefix_int(field(F.split(x, ",", -1), 2)).alias("prev_tx_id"), _prefix_int(field(F.split(x, ",", -1), 3)).alias("prev_offset")
    )
    out = cut.select(
        "file_seq",
        "line_seq",
        _prefix_int(field(F.col("info"), 0)).alias("ts"),
        field(F.col("info"), 1).alias("block_id"),
        _prefix_int(field(F.col("info"), 2)).alias("tx_id"),
        F.transform(ins, record).alias("inputs"),
        count_fields(F.get("s", F.lit(2))).alias("out_count"),
        F.size("info").alias("_fields"),
    )
    out = out.where("tx_id >= 0")
    if not lenient:
        out = out.where("_fields >= 3")
    return out.drop("_fields")


def parse_times(lines: DataFrame) -> DataFrame:
    """The lean parse: ``(file_seq, line_seq, ts, tx_id, out_count)``; inputs are never touched."""
    return parse(lines).select("file_seq", "line_seq", "ts", "tx_id", "out_count")


def numbered(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``read_seq``, the place in reading order."""
    return positions(parsed, ["file_seq", "line_seq"], "read_seq").drop("file_seq", "line_seq")


def first_occurrences(txs: DataFrame) -> DataFrame:
    """Each ``tx_id`` as first read; later lines of it are ignored wholly.

    A partial ``min`` over reading order, not a window: a repeated id is combined
    before it is shuffled.
    """
    rest = [c for c in txs.columns if c != "tx_id"]
    first = txs.groupBy("tx_id").agg(F.min_by(F.struct(*rest), "read_seq").alias("r"))
    return first.select("tx_id", "r.*").select(txs.columns)


def render(txs: DataFrame) -> DataFrame:
    """``value``: lines of ``(ts, block_id, tx_id, inputs, out_count)``, the inverse of :func:`parse`."""
    ins = F.array_join(F.transform("inputs", lambda i: F.format_string("a,0,%d,%d", i["prev_tx_id"], i["prev_offset"])), ";")
    outs = F.array_join(F.when(F.col("out_count") > 0, F.array_repeat(F.lit("a,0,0"), F.col("out_count"))).otherwise(F.array()), ";")
    return txs.select(F.format_string("%d,%s,%d:%s:%s", "ts", "block_id", "tx_id", ins, outs).alias("value"))
