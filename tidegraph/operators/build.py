"""Build the payment graph: nodes are transaction outputs, edges run from spent to created ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.operators.calendar import COUNT, FIRST_YEAR, chunk_of_epoch
from tidegraph.operators.numbering import running
from tidegraph.sources.transactions import first_occurrences


def based(txs: DataFrame, first_year: int = FIRST_YEAR, count: int = COUNT) -> DataFrame:
    """Distinct transactions with ``base``, the id of their first output, and ``chunk_id``."""
    first = first_occurrences(txs).withColumn("out_count", F.col("out_count").cast("long"))
    out = running(first, ["read_seq"], "out_count", "base").withColumn("base", F.col("base") - F.col("out_count"))
    return out.withColumn("chunk_id", chunk_of_epoch(F.col("ts"), first_year, count))


def nodes_of(tx: DataFrame) -> DataFrame:
    """``(node_id, tx_id, offset, ts, chunk_id)``, one row per output; also the creation times."""
    return tx.where("out_count > 0").select(
        "tx_id", "ts", "chunk_id", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("out_count") - 1)).alias("offset")
    ).select((F.col("base") + F.col("offset")).alias("node_id"), "tx_id", "offset", "ts", "chunk_id")


def resolved_inputs(tx: DataFrame) -> DataFrame:
    """``(tx_id, out_count, base, chunk_id, src)`` per input of transactions with outputs; src is null if unresolved.

    An input resolves to an output of a transaction read before, or of its own.
    """
    spends = tx.where("out_count > 0").select("tx_id", "read_seq", "out_count", "base", "chunk_id", F.explode("inputs").alias("i"))
    spends = spends.select("tx_id", "read_seq", "out_count", "base", "chunk_id", "i.prev_tx_id", "i.prev_offset")
    made = tx.select(F.col("tx_id").alias("p_id"), F.col("read_seq").alias("p_seq"), F.col("out_count").alias("p_count"), F.col("base").alias("p_base"))
    on = (F.col("prev_tx_id") == F.col("p_id")) & (F.col("p_seq") <= F.col("read_seq")) & (F.col("prev_offset") >= 0) & (F.col("prev_offset") < F.col("p_count"))
    return spends.join(made, on, "left").select("tx_id", "out_count", "base", "chunk_id", (F.col("p_base") + F.col("prev_offset")).alias("src"))


def edges_of(inputs: DataFrame) -> DataFrame:
    """``(src, dst, chunk_id)``: every distinct source of a transaction to each of its outputs."""
    sources = inputs.where("src IS NOT NULL").select("tx_id", "out_count", "base", "chunk_id", "src").distinct()
    return sources.select("src", F.explode(F.expr("sequence(base, base + out_count - 1)")).alias("dst"), "chunk_id")


def build(txs: DataFrame, first_year: int = FIRST_YEAR, count: int = COUNT) -> dict[str, DataFrame]:
    """``nodes``, ``edges`` and a one-row ``report`` of a numbered transaction list."""
    tx = scratch.materialize(based(txs, first_year, count), "tx")
    inputs = scratch.materialize(resolved_inputs(tx), "inputs")
    nodes, edges = nodes_of(tx), scratch.materialize(edges_of(inputs), "graph-edges")
    report = (
        tx.agg(F.count(F.lit(1)).alias("transactions"), F.coalesce(F.sum("out_count"), F.lit(0)).alias("nodes"))
        .crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each
        .crossJoin(txs.agg(F.count(F.lit(1)).alias("lines")))
        .crossJoin(inputs.agg(F.count_if(F.col("src").isNull()).alias("unresolved")))
        .select("transactions", "nodes", "edges", (F.col("lines") - F.col("transactions")).alias("duplicates"), "unresolved")
    )
    return {"tx": tx, "nodes": nodes, "edges": edges, "report": report}


def sorted_distinct(edges: DataFrame, keep_all: bool = False) -> DataFrame:
    """Edges in (src, dst) order, ranges over partitions; repeated ones go unless ``keep_all``."""
    out = edges if keep_all else edges.dropDuplicates(["src", "dst"])
    return out.orderBy("src", "dst")
