"""A payment graph from the order tables: an order is a transaction, its lines are outputs.

Each order spends, for every part it contains, the last output of that part in the
order before that contained it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.operators.calendar import chunk_of, half_years
from tidegraph.operators.numbering import positions

FIRST_YEAR, COUNT = 1995, 14
LINE_ORDER = ["tx_id", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]

_built: dict[tuple[str, str], dict[str, DataFrame]] = {}


def calendar(spark: SparkSession) -> DataFrame:
    return half_years(spark, FIRST_YEAR, COUNT)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return positions(orders, ["created_at", "o_orderkey"], "tx_id").withColumn("chunk_id", chunk_of(F.col("created_at"), FIRST_YEAR, COUNT))


def outputs(spark: SparkSession, sf_dir: str, tx: DataFrame) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *LINE_ORDER[1:])
    rows = lines.join(tx, F.col("l_orderkey") == F.col("o_orderkey"))
    return positions(rows, LINE_ORDER, "node_id").select("node_id", "tx_id", "chunk_id", "created_at", "l_partkey")


def _sources(nodes: DataFrame) -> DataFrame:
    """``(tx_id, l_partkey, src)``: what each transaction spends, by part."""
    last = nodes.groupBy("tx_id", "l_partkey").agg(F.max("node_id").alias("last"))
    spent = F.lag("last").over(Window.partitionBy("l_partkey").orderBy("tx_id"))
    return last.select("tx_id", "l_partkey", spent.alias("src")).where("src IS NOT NULL")


def parallel_edges(nodes: DataFrame) -> DataFrame:
    """``(src, dst)`` per part spent, before sources are made distinct."""
    rows = _sources(nodes).select("tx_id", "src").unionByName(_sources(nodes).select("tx_id", "src"))
    return rows.join(nodes.select("tx_id", F.col("node_id").alias("dst")), "tx_id").select("src", "dst")


def graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``tx``, ``nodes`` and ``edges``, written once a session and folder and read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        tx = scratch.materialize(transactions(spark, sf_dir), "tx")
        nodes = scratch.materialize(outputs(spark, sf_dir, tx), "nodes")
        inputs = _sources(nodes).select("tx_id", "src").distinct()
        edges = inputs.join(nodes.select("tx_id", "chunk_id", F.col("node_id").alias("dst")), "tx_id").select("src", "dst", "chunk_id")
        _built[key] = {"tx": tx, "nodes": nodes, "edges": scratch.materialize(edges, "edges")}
    return _built[key]


def derived(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that several queries read, made once a session and folder."""
    tables = graph(spark, sf_dir)
    if name not in tables:
        tables[name] = scratch.materialize(make(tables), name)
    return tables[name]
