"""Cumulative snapshots as a column: degrees and counts of every half-year in one job.

Nodes and edges carry the chunk of their creation and never change later, so the k-th
snapshot is ``chunk_id <= k`` and its histograms are running sums of changes per chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(nodes: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("chunk_id") <= k), edges.where(F.col("chunk_id") <= k)


def _until(nodes: DataFrame) -> DataFrame:
    """The chunks 1 .. last of the data; one row each."""
    return nodes.agg(F.max("chunk_id").alias("m")).select(F.explode(F.sequence(F.lit(1), F.col("m"))).alias("chunk_id"))


def evolution(nodes: DataFrame, edges: DataFrame, calendar: DataFrame) -> DataFrame:
    """``(chunk_id, nodes, arcs, avg_in_degree, avg_out_degree, end_date)`` of every snapshot."""
    n = nodes.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("e"))
    run = Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)  # a row per chunk
    rows = _until(nodes).join(n, "chunk_id", "left").join(e, "chunk_id", "left")
    rows = rows.select("chunk_id", F.sum(F.coalesce("n", F.lit(0))).over(run).alias("nodes"), F.sum(F.coalesce("e", F.lit(0))).over(run).alias("arcs"))
    mean = F.try_divide(F.col("arcs").cast("double"), F.col("nodes"))
    rows = rows.select("chunk_id", "nodes", "arcs", mean.alias("avg_in_degree"), mean.alias("avg_out_degree"))
    return rows.join(calendar.select("chunk_id", "end_date"), "chunk_id", "left")


def growth(evolved: DataFrame) -> DataFrame:
    """``(chunk_id, new_nodes)`` between consecutive snapshots; the first has none."""
    by = Window.orderBy("chunk_id")
    return evolved.select("chunk_id", (F.col("nodes") - F.lag("nodes").over(by)).alias("new_nodes")).where("new_nodes IS NOT NULL")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node_id, in_degree, out_degree)`` of the graph given, isolated nodes included."""
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    rows = nodes.select("node_id").join(into, "node_id", "left").join(out, "node_id", "left")
    return rows.select("node_id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def _accumulate(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Histograms of all snapshots from ``(chunk_id, degree, delta)``; a small table from here on."""
    small = changes.groupBy("chunk_id", "degree").agg(F.sum("delta").alias("delta"))
    each = small.select("degree").distinct().crossJoin(_until(nodes))  # distinct degrees x chunks
    run = Window.partitionBy("degree").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = each.join(small, ["chunk_id", "degree"], "left").select("chunk_id", "degree", F.sum(F.coalesce("delta", F.lit(0))).over(run).alias("freq"))
    return rows.where("freq > 0")


def in_degree_dist(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(chunk_id, degree, freq)`` of every snapshot; in-degrees are complete at creation."""
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("d"))
    rows = nodes.select("node_id", "chunk_id").join(into, "node_id", "left")
    return _accumulate(rows.select("chunk_id", F.coalesce("d", F.lit(0)).alias("degree"), F.lit(1).alias("delta")), nodes)


def out_degree_dist(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(chunk_id, degree, freq)`` of every snapshot, from each source's steps old -> new degree."""
    step = edges.groupBy("src", "chunk_id").agg(F.count(F.lit(1)).alias("m"))
    run = Window.partitionBy("src").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    step = step.select("chunk_id", F.sum("m").over(run).alias("new"), "m")
    moves = step.select("chunk_id", F.explode(F.array(F.struct((F.col("new") - F.col("m")).alias("degree"), F.lit(-1).alias("delta")), F.struct(F.col("new").alias("degree"), F.lit(1).alias("delta")))).alias("x"))
    born = nodes.select("chunk_id", F.lit(0).cast("long").alias("degree"), F.lit(1).alias("delta"))
    return _accumulate(born.unionByName(moves.select("chunk_id", "x.degree", "x.delta")), nodes)


def densify(dist: DataFrame, value: str = "degree", freq: str = "freq", group: str = "chunk_id") -> DataFrame:
    """Every value from 0 to the group's largest, zeros included."""
    top = dist.groupBy(group).agg(F.max(value).alias("m")).select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias(value))
    return top.join(dist, [group, value], "left").withColumn(freq, F.coalesce(freq, F.lit(0)))
