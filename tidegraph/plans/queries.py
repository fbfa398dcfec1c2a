"""One query per operator of the inventory, over the derived payment graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.functions import powerlaw, stats
from tidegraph.operators import build, components, depth, distance, snapshots
from tidegraph.operators.calendar import chunk_of, label, monotone_chunks
from tidegraph.plans import testgraph, views
from tidegraph.sources import files, sinks, transactions

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _dist(spark, sf_dir, side: str) -> DataFrame:
    make = snapshots.in_degree_dist if side == "in" else snapshots.out_degree_dist
    return testgraph.derived(spark, sf_dir, f"{side}_dist", lambda t: make(t["nodes"], t["edges"]))


def _sizes(spark, sf_dir) -> DataFrame:
    return testgraph.derived(spark, sf_dir, "sizes", lambda t: components.size_series(t["nodes"], t["edges"]))


def _depth(spark, sf_dir) -> DataFrame:
    return testgraph.derived(spark, sf_dir, "depth", lambda t: depth.depths(t["nodes"], t["edges"]))


def _evolution(spark, sf_dir) -> DataFrame:
    t = testgraph.graph(spark, sf_dir)
    return snapshots.evolution(t["nodes"], t["edges"], testgraph.calendar(spark))


def _moment(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query
def chunk_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testgraph.calendar(spark)
    return rows.select(F.col("chunk_id").cast("int").alias("chunk_id"), label(F.col("chunk_id"), testgraph.FIRST_YEAR).alias("label"), _moment("start_date"), _moment("end_date"))


@query
def chunk_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by chunk of a calendar that ends early; what lies outside counts as chunk -1."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("timestamp").alias("ts"))
    rows = orders.groupBy(F.coalesce(chunk_of(F.col("ts"), testgraph.FIRST_YEAR, 10), F.lit(-1)).alias("chunk_id"))
    return rows.agg(F.count(F.lit(1)).alias("n_tx"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("chunk_id", "n_tx", _moment("first_ts"), _moment("last_ts"))


@query
def tx_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrence of each supplier in order of the lines' nodes' transactions."""
    tx = testgraph.graph(spark, sf_dir)["nodes"]
    rows = tx.select(F.col("l_partkey").alias("tx_id"), F.col("node_id").alias("read_seq"), F.col("tx_id").alias("seen_in"))
    return transactions.first_occurrences(rows)


@query
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testgraph.graph(spark, sf_dir)["nodes"].select("node_id", "tx_id", "chunk_id", F.unix_timestamp("created_at").alias("ts"))


@query
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testgraph.graph(spark, sf_dir)["edges"].select("src", "dst", "chunk_id")


@query
def build_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph rendered as text lines, parsed and built again: its report."""
    return _from_text(spark, sf_dir)["report"].select(*[F.col(c).cast("long").alias(c) for c in ("transactions", "nodes", "edges", "duplicates", "unresolved")])


@query
def build_edges_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_text(spark, sf_dir)["edges"].select("src", "dst", F.col("chunk_id").cast("int").alias("chunk_id"))


def _from_text(spark, sf_dir) -> dict[str, DataFrame]:
    t = testgraph.graph(spark, sf_dir)
    first = t["nodes"].groupBy("tx_id").agg(F.min("node_id").alias("base"), F.count(F.lit(1)).alias("out_count"))
    spent = testgraph._sources(t["nodes"]).select("tx_id", "src")
    made = t["nodes"].select(F.col("node_id").alias("src"), F.col("tx_id").alias("prev_tx_id"))
    spent = spent.join(made, "src").join(first.select(F.col("tx_id").alias("prev_tx_id"), "base"), "prev_tx_id")
    ins = spent.groupBy("tx_id").agg(F.collect_list(F.struct("prev_tx_id", (F.col("src") - F.col("base")).alias("prev_offset"))).alias("inputs"))
    # The first output number past its transaction's end: an input that cannot resolve.
    tx = t["tx"].join(first, "tx_id", "left").join(ins, "tx_id", "left").withColumn("out_count", F.coalesce("out_count", F.lit(0)).cast("int"))
    empty = F.array().cast("array<struct<prev_tx_id: bigint, prev_offset: bigint>>")
    broken = F.array(F.struct(F.col("tx_id").alias("prev_tx_id"), F.lit(1_000_000).cast("long").alias("prev_offset")))
    inputs = F.concat(F.coalesce("inputs", empty), F.when(F.col("tx_id") % 100 == 7, broken).otherwise(empty))
    rows = tx.select(F.unix_timestamp("created_at").alias("ts"), F.lit("0").alias("block_id"), "tx_id", inputs.alias("inputs"), "out_count")
    lines = transactions.render(rows)
    again = transactions.render(rows.where("tx_id % 50 = 3"))  # duplicates, read last
    number = lambda df, k: df.select(F.lit(k).alias("file_seq"), F.split(F.split("value", ":")[0], ",")[2].cast("long").alias("line_seq"), "value")
    parsed = transactions.parse(number(lines, 0).unionByName(number(again, 1)))
    return build.build(transactions.numbered(parsed), testgraph.FIRST_YEAR, testgraph.COUNT)


@query
def edges_sorted_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.sorted_distinct(testgraph.parallel_edges(testgraph.graph(spark, sf_dir)["nodes"]))


@query
def snapshot_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _round(_evolution(spark, sf_dir), "avg_in_degree", "avg_out_degree")
    return _long(rows, "nodes", "arcs").select("chunk_id", "nodes", "arcs", "avg_in_degree", "avg_out_degree", _moment("end_date"))


@query
def node_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(snapshots.growth(_evolution(spark, sf_dir)), "new_nodes")


@query
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testgraph.graph(spark, sf_dir)
    return snapshots.degrees(t["nodes"], t["edges"])


@query
def in_degree_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(snapshots.densify(_dist(spark, sf_dir, "in")), "degree", "freq")


@query
def out_degree_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(snapshots.densify(_dist(spark, sf_dir, "out")), "degree", "freq")


def _both(spark, sf_dir, f, name: str) -> DataFrame:
    a = f(_dist(spark, sf_dir, "in"), "degree", "freq").withColumnRenamed(name, f"{name}_in")
    b = f(_dist(spark, sf_dir, "out"), "degree", "freq").withColumnRenamed(name, f"{name}_out")
    return _round(a.join(b, "chunk_id"), f"{name}_in", f"{name}_out")


@query
def degree_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, stats.gini, "gini")


@query
def degree_hellinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, stats.hellinger_series, "hellinger")


@query
def degree_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, stats.ks_series, "ks")


@query
def hellinger_matrix_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.hellinger_matrix(_dist(spark, sf_dir, "in"), "degree", "freq"), "hellinger")


@query
def hellinger_matrix_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.hellinger_matrix(_dist(spark, sf_dir, "out"), "degree", "freq"), "hellinger")


@query
def hellinger_matrix_in_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = _round(stats.hellinger_matrix(_dist(spark, sf_dir, "in"), "degree", "freq"), "hellinger")
    return stats.matrix_wide(matrix, groups=list(range(1, testgraph.COUNT + 1)))


@query
def powerlaw_alpha_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(powerlaw.closed_form(_dist(spark, sf_dir, "in"), "degree", "freq", 2), "alpha")


@query
def powerlaw_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = powerlaw.fit(_dist(spark, sf_dir, "in"), "degree", "freq").withColumn("side", F.lit("in"))
    return a.unionByName(powerlaw.fit(_dist(spark, sf_dir, "out"), "degree", "freq").withColumn("side", F.lit("out"))).drop("elapsed_time")


@query
def wcc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the first snapshot, by distributed contraction."""
    t = testgraph.graph(spark, sf_dir)
    return components.wcc(*snapshots.snapshot(t["nodes"], t["edges"], 1), one_task_edges=0)


@query
def wcc_labels_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testgraph.graph(spark, sf_dir)
    return components.wcc(t["nodes"], t["edges"])


@query
def wcc_size_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_sizes(spark, sf_dir), "size", "num_comp")


@query
def wcc_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = components.connectivity(_sizes(spark, sf_dir), _evolution(spark, sf_dir))
    return _long(_round(rows, "coverage", "isolated_pct"), "nodes", "components", "giant", "isolated")


@query
def wcc_hellinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _sizes(spark, sf_dir)
    a = stats.hellinger_series(d, "size", "num_comp", "rank").withColumnRenamed("hellinger", "by_rank")
    b = stats.hellinger_series(d, "size", "num_comp", "value").withColumnRenamed("hellinger", "by_value")
    return _round(a.join(b, "chunk_id"), "by_rank", "by_value")


@query
def wcc_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.gini(_sizes(spark, sf_dir), "size", "num_comp"), "gini")


@query
def wcc_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.ks_series(_sizes(spark, sf_dir), "size", "num_comp"), "ks")


@query
def hellinger_matrix_wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.hellinger_matrix(_sizes(spark, sf_dir), "size", "num_comp", "rank"), "hellinger")


@query
def depth_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depth(spark, sf_dir).select("node_id", "d_min")


@query
def depth_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depth(spark, sf_dir).select("node_id", "d_max")


@query
def depth_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depth(spark, sf_dir).select("node_id", "src_max", "src_min")


@query
def depth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(depth.summary(_depth(spark, sf_dir), testgraph.graph(spark, sf_dir)["edges"]), "mean_d_max", "mean_d_min")


@query
def depth_dist_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.histogram(_depth(spark, sf_dir), "d_max")


@query
def depth_dist_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.histogram(_depth(spark, sf_dir), "d_min")


@query
def depth_cumulative_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_round(stats.cumulative_share(depth.histogram(_depth(spark, sf_dir), "d_max"), "d", "freq"), "share"), "freq")


@query
def depth_cumulative_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_round(stats.cumulative_share(depth.histogram(_depth(spark, sf_dir), "d_min"), "d", "freq"), "share"), "freq")


@query
def depth_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.top_sources(_depth(spark, sf_dir))


def _cohorts(spark, sf_dir, column: str) -> DataFrame:
    return depth.cohorts(_depth(spark, sf_dir), testgraph.graph(spark, sf_dir)["nodes"], column)


@query
def depth_cohort_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _cohorts(spark, sf_dir, "d_max").withColumn("measure", F.lit("d_max"))
    return a.unionByName(_cohorts(spark, sf_dir, "d_min").withColumn("measure", F.lit("d_min")))


@query
def depth_cohort_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stats.weighted_moments(_cohorts(spark, sf_dir, "d_max"), "d", "freq").select("chunk_id", "total", F.col("mean").alias("mean_max"), F.col("std").alias("std_max"))
    b = stats.weighted_moments(_cohorts(spark, sf_dir, "d_min"), "d", "freq").select("chunk_id", F.col("mean").alias("mean_min"), F.col("std").alias("std_min"))
    return _round(a.join(b, "chunk_id"), "mean_max", "std_max", "mean_min", "std_min")


@query
def depth_cohort_hellinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for m in ("d_max", "d_min"):
        for align in ("rank", "value"):
            one = stats.hellinger_series(_cohorts(spark, sf_dir, m), "d", "freq", align).select("chunk_id", F.lit(m).alias("measure"), F.lit(align).alias("align"), "hellinger")
            out = one if out is None else out.unionByName(one)
    return _round(out, "hellinger")


@query
def depth_cohort_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stats.hellinger_matrix(_cohorts(spark, sf_dir, "d_max"), "d", "freq", "rank").withColumn("measure", F.lit("d_max"))
    b = stats.hellinger_matrix(_cohorts(spark, sf_dir, "d_min"), "d", "freq", "rank").withColumn("measure", F.lit("d_min"))
    return _round(a.unionByName(b), "hellinger")


@query
def distance_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testgraph.graph(spark, sf_dir)
    return distance.exact(*snapshots.snapshot(t["nodes"], t["edges"], 1))


@query
def distance_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testgraph.graph(spark, sf_dir)
    return distance.ball_report(distance.hyperball(t["nodes"], t["edges"]))


@query
def depth_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths and their sources by the distributed path: four blocks, or more where four would not fit a task each."""
    t = testgraph.graph(spark, sf_dir)
    return depth.depths(t["nodes"], t["edges"], block_edges=t["edges"].count() // 4 + 1).select("node_id", "d_max", "d_min", "src_max", "src_min")


@query
def wcc_size_dist_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component sizes of all snapshots by distributed contraction, whatever the size."""
    t = testgraph.graph(spark, sf_dir)
    return _long(components.size_series(t["nodes"], t["edges"], one_task_edges=0), "size", "num_comp")


@query
def cursor_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the cursor of nearly sorted input: every fifth node comes 40 days late, the calendar ends after ten half-years."""
    nodes = testgraph.graph(spark, sf_dir)["nodes"]
    late = F.when(F.col("node_id") % 5 == 0, F.col("created_at") - F.expr("INTERVAL 40 DAYS")).otherwise(F.col("created_at"))
    moment = F.greatest(late.cast("timestamp"), F.lit(f"{testgraph.FIRST_YEAR}-01-01 00:00:00").cast("timestamp"))
    rows = nodes.select("node_id", chunk_of(moment, testgraph.FIRST_YEAR, 10).alias("chunk_id"))
    return monotone_chunks(rows, "node_id", "chunk_id").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("nodes"), F.min("node_id").alias("first_node"), F.max("node_id").alias("last_node"))


@query
def snapshot_evolution_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second snapshot."""
    return _long(_evolution(spark, sf_dir).where("chunk_id % 2 = 0"), "nodes", "arcs").select("chunk_id", "nodes", "arcs")


@query
def views_edges_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's views in SQL; edges are counted by chunk before the calendar meets them, as a join by 14 keys would sort all edges in 14 tasks."""
    t = testgraph.graph(spark, sf_dir)
    views.register(t["nodes"], t["edges"], testgraph.calendar(spark))
    return spark.sql(
        "SELECT CAST(c.chunk_id AS INT) AS chunk_id, coalesce(e.arcs, 0L) AS arcs, coalesce(e.targets, 0L) AS targets FROM pg_calendar c LEFT JOIN "
        "(SELECT chunk_id, count(src) AS arcs, count(DISTINCT dst) AS targets FROM pg_edges GROUP BY chunk_id) e ON e.chunk_id = c.chunk_id"
    )


@query
def degree_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-degrees of the last snapshot, written as one count a line and read again."""
    where = scratch.path(spark, "degrees")
    sinks.write_degree_counts(_dist(spark, sf_dir, "in").where(F.col("chunk_id") == testgraph.COUNT), where)
    return files.read_degree_counts(spark, where)


@query
def stats_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot's numbers as ``key=value`` lines and read again."""
    where = scratch.path(spark, "stats")
    sinks.write_stats(_evolution(spark, sf_dir).where(F.col("chunk_id") == testgraph.COUNT).select("chunk_id", "nodes", "arcs"), where)
    return files.read_stats(spark, where).select("key", F.col("int_value").alias("value"))


@query
def edges_table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as separated text, then streamed to Parquet, and read again."""
    text, parquet = scratch.path(spark, "edges"), scratch.path(spark, "edges")
    sinks.write_tsv(testgraph.graph(spark, sf_dir)["edges"].select("src", "dst", "chunk_id"), text)
    files.text_to_parquet(spark, text, parquet, schema="src long, dst long, chunk_id int")
    return spark.read.parquet(parquet)


@query
def edges_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed graph (sorted Parquet by chunk, zstd 12 for its copy) written and read again."""
    where, copy = scratch.path(spark, "graph"), scratch.path(spark, "copy")
    t = testgraph.graph(spark, sf_dir)
    sinks.write_graph(t["nodes"], t["edges"].select("src", "dst", "chunk_id"), where)
    sinks.write_parquet_zstd(spark.read.parquet(f"{where}/edges"), copy)
    return spark.read.parquet(copy).select("src", "dst", F.col("chunk_id").cast("int").alias("chunk_id"))


@query
def components_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the first snapshot, written as one number a line in node order and read again."""
    where = scratch.path(spark, "components")
    sinks.write_components(wcc_labels(spark, sf_dir), where)
    return files.read_degree_counts(spark, where).select(F.col("degree").alias("node_rank"), F.col("freq").alias("comp_id"))
