"""Goldens of the derived graph, files, statistics and the entry point."""

import struct
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.functions import powerlaw, stats
from tidegraph.operators import classes, depth, distance
from tidegraph.plans import queries, registry, testgraph
from tidegraph.sources import files, sinks

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    return testgraph.graph(spark, SMALL)


def test_goldens(spark, graph):
    assert (graph["nodes"].count(), graph["edges"].count()) == (6000, 28671)
    row = registry.QUERIES["depth_summary"](spark, SMALL).first()
    assert (row.sources, row.max_d_max, row.deepest, row.deepest_source, row.max_d_min) == (45, 225, 5986, 39, 11)
    assert (row.mean_d_max, row.mean_d_min) == (pytest.approx(110.674333), pytest.approx(5.518667))
    top = registry.QUERIES["depth_top_sources"](spark, SMALL).limit(3).collect()
    assert [tuple(r) for r in top] == [(39, 5827), (4, 94), (3, 11)]


def test_blocks_give_the_same_depths(graph):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(depth.depths(graph["nodes"], graph["edges"], 6000)) == key(depth.depths(graph["nodes"], graph["edges"]))


def test_no_block_is_larger_than_a_task_holds(spark, graph, monkeypatch):
    want = sorted(tuple(r) for r in depth.depths(graph["nodes"], graph["edges"]).collect())
    blocks, append = [], depth.scratch.append
    monkeypatch.setattr(depth, "BLOCK_EDGES", 5000)
    monkeypatch.setattr(depth.scratch, "append", lambda df, where, *a, **k: (blocks.append(where) if "/b=" in where else None, append(df, where, *a, **k))[1])
    assert sorted(tuple(r) for r in queries.depth_blocks(spark, SMALL).collect()) == want and len(blocks) == 6


def test_edges_are_counted_before_they_meet_the_calendar(spark):
    df = queries.views_edges_by_chunk(spark, SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Aggregate")
    edges = registry.QUERIES["graph_edges"](spark, SMALL).collect()
    want = {k: (sum(e.chunk_id == k for e in edges), len({e.dst for e in edges if e.chunk_id == k})) for k in range(1, testgraph.COUNT + 1)}
    assert {r.chunk_id: (r.arcs, r.targets) for r in df.collect()} == want


def test_every_query_has_sql_or_a_reason(spark):
    without = {"powerlaw_fit", "distance_hll"}
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == without


def test_entry_imports():
    import __spark_entry__ as e

    assert {"snapshot_evolution", "wcc_labels"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_statistics_by_hand(spark):
    d = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 2, 1), (3, 0, 5), (3, 1, 5)], "chunk_id int, v long, n long")
    h = {(r.i, r.j): r.hellinger for r in stats.hellinger_matrix(d, "v", "n").collect()}
    assert h[1, 3] == pytest.approx(0, abs=1e-7) and h[1, 2] == h[2, 1] == pytest.approx(np.sqrt(0.5)) and h[2, 2] == 0
    ks = {r.chunk_id: r.ks for r in stats.ks_series(d, "v", "n").collect()}
    assert ks == {2: pytest.approx(0.5), 3: pytest.approx(0.5)}
    m = {r.chunk_id: (r.total, r["mean"], r["std"]) for r in stats.weighted_moments(d, "v", "n").collect()}
    assert m[2] == (2, 1.0, 1.0)
    none = stats.weighted_moments(spark.createDataFrame([(1, 0, 0)], "chunk_id int, v long, n long"), "v", "n").first()
    assert none["mean"] is None and none["std"] is None
    share = stats.cumulative_share(d.where("chunk_id = 3"), "v", "n").orderBy("v").collect()
    assert [r.share for r in share] == [0.5, 1.0]


def test_power_law_recovers_its_exponent(spark):
    x = np.arange(1, 3000)
    n = np.round(2e6 * x**-2.5 / powerlaw.zeta(2.5, np.array([1.0]))).astype(int)
    alpha, low, _, gap, _ = powerlaw.fit_histogram(x, n)
    assert alpha == pytest.approx(2.5, abs=0.02) and gap < 0.01
    assert powerlaw.zeta(2.0, np.array([1.0]))[0] == pytest.approx(np.pi**2 / 6)
    rows = [(1, int(a), int(b)) for a, b in zip(x, n) if b] + [(2, 0, 7)]
    fit = {r.chunk_id: r for r in powerlaw.fit(spark.createDataFrame(rows, "chunk_id int, degree long, freq long"), "degree", "freq").collect()}
    assert fit[1].alpha == pytest.approx(alpha) and fit[2].alpha is None


def test_distances(spark):
    nodes = spark.range(5).withColumnRenamed("id", "node_id")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    assert {r.distance: r.pairs for r in distance.exact(nodes, edges).collect()} == {1: 3, 2: 2, 3: 1}
    assert {r.distance: r.pairs for r in distance.exact(nodes, edges, directed=False).collect()} == {1: 6, 2: 4, 3: 2}
    exact = distance.report(distance.exact(nodes, edges)).first()
    found = distance.ball_report(distance.hyperball(nodes, edges)).first()
    assert found["diameter"] == exact["diameter"] == 3 and found["avg_distance"] == pytest.approx(exact["avg_distance"], rel=0.05)


@pytest.mark.parametrize("directed", [True, False])
def test_exact_distances_list_no_pairs(spark, monkeypatch, directed):
    """Cycles, repeated edges, loops and components over several blocks; the table of pairs gives the same."""
    rng = np.random.default_rng(5)
    ends = rng.integers(0, 90, (150, 2)) + 100 * rng.integers(0, 3, (150, 1))
    edges = spark.createDataFrame([*map(tuple, ends.tolist()), (1, 1), (2, None)], "src long, dst long")
    nodes = spark.range(300).withColumnRenamed("id", "node_id")
    step = {(a, b) for a, b in ends.tolist() if a != b}
    step |= set() if directed else {(b, a) for a, b in step}
    want, seen = {}, {(a, a) for a, _ in step}
    front, d = seen, 0
    while front:
        front = {(a, y) for a, b in front for x, y in step if x == b} - seen
        seen, d = seen | front, d + 1
        want |= {d: len(front)} if front else {}
    found = lambda **a: {r.distance: r.pairs for r in distance.exact(nodes, edges, directed, **a).collect()}
    assert found(task_edges=0) == want
    monkeypatch.setattr(distance, "SOURCES", 16)
    monkeypatch.setattr(distance, "_by_pairs", None)
    assert found() == want


def test_exact_distances_by_classes(spark, monkeypatch):
    """Edges to higher ids, with twins, repeated edges, loops and several blocks, bits and parts; a large component is no hindrance."""
    rng = np.random.default_rng(6)
    ends = np.sort(rng.integers(0, 120, (160, 2)), axis=1)
    twins = np.array([(300, 400 + i) for i in range(40)] + [(j, 300) for j in range(5)] + [(200 + i, 400 + j) for i in range(30) for j in range(20, 25)])
    ends = np.concatenate([ends, ends[:20], twins])
    step = {(a, b) for a, b in ends.tolist() if a != b}
    want, seen = {}, {(a, a) for a, _ in step}
    front, d = seen, 0
    while front:
        front = {(a, y) for a, b in front for x, y in step if x == b} - seen
        seen, d = seen | front, d + 1
        want |= {d: len(front)} if front else {}
    nodes, edges = spark.range(500).withColumnRenamed("id", "node_id"), spark.createDataFrame([*map(tuple, ends.tolist()), (2, None)], "src long, dst long")
    monkeypatch.setattr(distance, "_by_pairs", None)
    monkeypatch.setattr(classes, "BLOCK", 20)
    assert {r.distance: r.pairs for r in distance.exact(nodes, edges, task_edges=0).collect()} == want
    monkeypatch.setattr(classes, "TABLES", 1)
    monkeypatch.setattr(classes, "PART", 1)
    monkeypatch.setattr(classes, "BLOCK", 1000)
    assert {r.distance: r.pairs for r in distance.exact(nodes, edges, task_edges=0).collect()} == want


def test_sketches_of_the_whole_graph(spark):
    t = testgraph.graph(spark, "/root/testdata/sf0.001")
    after = {r.node_id: [] for r in t["nodes"].select("node_id").collect()}
    for r in t["edges"].select("src", "dst").distinct().collect():
        after[r.src].append(r.dst)
    place = {v: i for i, v in enumerate(after)}
    ball, pairs = {v: 1 << i for v, i in place.items()}, []
    while True:
        new = {v: reduce(lambda a, b: a | ball[b], after[v], ball[v]) for v in after}
        pairs.append(sum(b.bit_count() for b in new.values()) - sum(b.bit_count() for b in ball.values()))
        ball = new
        if not pairs[-1]:
            break
    exact = sum((d + 1) * n for d, n in enumerate(pairs)) / sum(pairs)
    found = queries.distance_hll(spark, "/root/testdata/sf0.001").first()
    assert found["avg_distance"] == pytest.approx(exact, rel=0.05) and abs(found["diameter"] - (len(pairs) - 1)) <= 1


def test_sketches_by_classes(spark, monkeypatch):
    """Slices of all sketches give what whole ones give, and what plain sketches of every node give; no table of sketches is written."""
    rng = np.random.default_rng(7)
    ends = np.sort(rng.integers(0, 400, (700, 2)), axis=1)
    ends = np.concatenate([ends, [(400, 500 + i) for i in range(60)], [(j, 400) for j in range(9)]])
    step = sorted({(a, b) for a, b in ends.tolist() if a != b})
    nodes, edges = spark.range(600).withColumnRenamed("id", "node_id"), spark.createDataFrame([*step, step[0]], "src long, dst long")
    names, plain = [], distance.scratch.materialize
    monkeypatch.setattr(distance.scratch, "materialize", lambda df, name, *a: names.append(name) or plain(df, name, *a))
    found = {r.distance: r.reached for r in distance.hyperball(nodes, edges).collect()}
    assert "balls" not in names
    for name, value in (("SLICES", 50), ("RANGE", 64), ("PACK", 40), ("PART", 1)):
        monkeypatch.setattr(classes, name, value)
    assert {r.distance: r.reached for r in distance.hyperball(nodes, edges).collect()} == pytest.approx(found)
    at, value = classes._hashed(np.arange(600), 10)
    ball = np.zeros((600, 1024), np.uint8)
    ball[np.arange(600), at] = value
    for d in range(1, len(found)):
        near = ball.copy()
        for a, b in step:
            near[a] = np.maximum(near[a], ball[b])
        ball = near
        assert classes._estimates(classes._terms(10)[ball].sum(axis=1), 10).sum() == pytest.approx(found[d], rel=0.01)
    assert found[0] == 600 and len(found) > 6 and all((np.maximum(ball[a], ball[b]) == ball[a]).all() for a, b in step)


def test_sketches_raise_on_a_cap(spark):
    nodes, edges = spark.range(6).withColumnRenamed("id", "node_id"), spark.range(5).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    with pytest.raises(RuntimeError):
        distance.hyperball(nodes, edges, max_rounds=3).count()


def test_flat_files(spark, tmp_path):
    (tmp_path / "e.bin").write_bytes(struct.pack("<4Q", 1, 2, 3, 2**40))
    assert sorted(tuple(r) for r in files.read_edges(spark, str(tmp_path / "e.bin")).collect()) == [(1, 2), (3, 2**40)]
    (tmp_path / "v.bin").write_bytes(struct.pack("<3I", 7, 0xFFFFFFFF, 9))
    assert [tuple(r) for r in files.read_vector(spark, str(tmp_path / "v.bin")).orderBy("node_id").collect()] == [(0, 7), (1, None), (2, 9)]
    (tmp_path / "d.bin").write_bytes(struct.pack("<IQIQ", 0, 5, 3, 2**35))
    assert sorted(tuple(r) for r in files.read_packed_dist(spark, str(tmp_path / "d.bin")).collect()) == [(0, 5), (3, 2**35)]
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(ValueError):
        files.read_edges(spark, str(tmp_path / "bad.bin"))
    (tmp_path / "deg").write_text("4\n6\n\n0\n1\n")
    assert [tuple(r) for r in files.read_degree_counts(spark, str(tmp_path / "deg")).orderBy("degree").collect()] == [(0, 4), (1, 6), (2, 0), (3, 1)]
    (tmp_path / "s").write_text("nodes=12\nskip\navg=1.5\nname=a=b\n")
    got = {r.key: (r.value, r.int_value, r.float_value) for r in files.read_stats(spark, str(tmp_path / "s")).collect()}
    assert got == {"nodes": ("12", 12, 12.0), "avg": ("1.5", None, 1.5), "name": ("a=b", None, None)}
    (tmp_path / "r").write_text("average distance (12.5 over 31)\n")
    assert tuple(files.read_distance_report(spark, str(tmp_path / "r")).first()) == (12.5, 31)
    (tmp_path / "t").write_text("1\t2\n3\t4\n")
    assert files.read_table(spark, str(tmp_path / "t"), header=False).columns == ["column_1", "column_2"]


def test_sinks_round_trip(spark, graph, tmp_path):
    sinks.write_graph(graph["nodes"], graph["edges"], str(tmp_path / "g"))
    back = spark.read.parquet(str(tmp_path / "g/edges"))
    assert back.where("chunk_id <= 2").count() == 3853
    plan = back.where("chunk_id <= 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chunk_id" in plan
    sinks.write_chunked_text(spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id int, value string"), str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if p.is_dir()) == ["chunk_id=1", "chunk_id=2"]
    rows = sinks.with_empty_chunks(spark.createDataFrame([(2, 9)], "chunk_id int, d long"), testgraph.calendar(spark).where(F.col("chunk_id") <= 3))
    assert sorted((r.chunk_id, r.d) for r in rows.collect()) == [(1, None), (2, 9), (3, None)]
