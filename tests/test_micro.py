"""The twelve-line fixture and its variations: every quirk of the format, with full expected output."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import stats
from tidegraph.operators import build, components, depth, snapshots
from tidegraph.operators.calendar import chunk_of_epoch, half_years, label, monotone_chunks
from tidegraph.sources import transactions

LINES = """\
1230768000,0,0,1,0::addrA,50,0
1235000000,1,1,1,0::addrB,50,0
1240000000,2,2,0,1:addrA,50,0,0:addrC,30,0;addrA,19,0
1246406400,3,3,0,1:addrC,30,2,0;addrA,19,2,1;addrB,50,1,0:addrD,99,0;
1246406401,3,4,1,0::addrE,50,0
1250000000,4,5,0,1:addrD,99,3,0;addrD,99,3,0:addrF,40,0;addrG,40,0;addrD,19,0
1250000000,4,5,0,1:addrD,99,3,0:addrX,1,0
1262304000,5,6,0,1:addrG,40,5,1;addrZ,7,99,0:addrH,40,0
1270000000,6,7,0,1:addrF,40,5,0:

no separators here
1277942400,7,8,1,0::addrI,50,0
"""

SNAPSHOTS = {  # nodes, arcs, wcc, isolated, giant, gini in/out/wcc
    1: (4, 2, 2, 1, 3, 0.5, 0.75, 0.25),
    2: (9, 8, 2, 1, 8, 0.472222, 0.583333, 0.388889),
    3: (10, 9, 2, 1, 9, 0.433333, 0.544444, 0.4),
    4: (11, 9, 3, 2, 9, 0.484848, 0.585859, 0.484848),
}
STEPS = {  # hellinger in/out/wcc by rank/by value, ks in/out/wcc
    2: (0.254373, 0.505948, 0.0, 0.707107, 0.166667, 0.305556, 0.5),
    3: (0.031823, 0.04895, 0.0, 0.707107, 0.033333, 0.044444, 0.5),
    4: (0.047823, 0.039, 0.120006, 0.120006, 0.063636, 0.054545, 0.166667),
}


def built(spark, tmp_path, text, name="list.txt"):
    path = tmp_path / name
    path.write_text(text)
    lines = transactions.read_lines(spark, [str(path)])
    return build.build(transactions.numbered(transactions.parse(lines)))


@pytest.fixture(scope="module")
def micro(spark, tmp_path_factory):
    return built(spark, tmp_path_factory.mktemp("micro"), LINES)


def test_report(micro):
    assert micro["report"].first().asDict() == {"transactions": 9, "nodes": 11, "edges": 9, "duplicates": 1, "unresolved": 1}


def test_nodes_and_edges(micro):
    nodes = {(r.tx_id, r.offset): (r.node_id, r.chunk_id) for r in micro["nodes"].collect()}
    keys = [(0, 0), (1, 0), (2, 0), (2, 1), (3, 0), (4, 0), (5, 0), (5, 1), (5, 2), (6, 0), (8, 0)]
    assert nodes == {k: (i, c) for i, (k, c) in enumerate(zip(keys, [1, 1, 1, 1, 2, 2, 2, 2, 2, 3, 4]))}
    edges = sorted((r.src, r.dst) for r in micro["edges"].collect())
    assert edges == [(0, 2), (0, 3), (1, 4), (2, 4), (3, 4), (4, 6), (4, 7), (4, 8), (7, 9)]


def test_components(micro):
    labels = {r.node_id: r.comp_id for r in components.wcc(micro["nodes"], micro["edges"]).collect()}
    assert [labels[i] for i in range(11)] == [0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 2]
    sizes = {r["size"]: r.num_comp for r in components.size_distribution(components.wcc(micro["nodes"], micro["edges"])).collect()}
    assert sizes == {1: 2, 9: 1}


def random_graph(spark, n=600, gaps=1):
    """Edges rise and come with their later end; ids may have gaps."""
    rng = random.Random(7)
    born = sorted(rng.randint(1, 5) for _ in range(n))
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(n * 2 // 3)}, key=lambda p: rng.random())
    nodes = spark.createDataFrame([(i * gaps, k) for i, k in enumerate(born)], "node_id long, chunk_id int")
    return nodes, spark.createDataFrame([(a * gaps, b * gaps, born[b]) for a, b in pairs], "src long, dst long, chunk_id int"), born, pairs


def roots(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a, b in pairs):
            return label


@pytest.mark.parametrize("gaps", [1, 3])
@pytest.mark.parametrize("piece", [50, 2_000_000])
def test_graphs_over_five_million_rows_need_no_rounds(spark, monkeypatch, gaps, piece):
    """Sizes of all snapshots and labels of the whole from one pass over the contracted edges."""
    nodes, edges, born, pairs = random_graph(spark, gaps=gaps)
    monkeypatch.setattr(components, "PIECE", piece)
    monkeypatch.setattr(components, "PACK", 64)
    monkeypatch.setattr(components, "connected_components", None)
    want = {}
    for k in range(1, 6):
        label = roots(len(born), [(a, b) for a, b in pairs if born[b] <= k])
        sizes = Counter(label[i] for i in range(len(born)) if born[i] <= k)
        want |= {(k, size): n for size, n in Counter(sizes.values()).items()}
    assert {(r.chunk_id, r["size"]): r.num_comp for r in components.size_series(nodes, edges, 10_000).collect()} == want
    label = roots(len(born), pairs)
    number = {r: i for i, r in enumerate(sorted(set(label)))}
    assert {r.node_id: r.comp_id for r in components.wcc(nodes, edges, 10_000).collect()} == {i * gaps: number[label[i]] for i in range(len(born))}


def test_vertices_that_are_no_nodes_join_but_have_no_number(spark):
    nodes = spark.createDataFrame([(1,), (3,), (4,), (6,), (9,)], "node_id long")
    edges = spark.createDataFrame([(0, 4), (0, 9), (3, 5), (5, 6), (None, 1), (1, 1)], "src long, dst long")
    assert {r.node_id: r.comp_id for r in components.wcc(nodes, edges).collect()} == {1: 0, 3: 1, 4: 2, 6: 1, 9: 2}


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_depths(micro, block):
    rows = {r.node_id: r for r in depth.depths(micro["nodes"], micro["edges"], block).collect()}
    assert [rows[i].d_max for i in range(11)] == [0, 0, 1, 1, 2, 0, 3, 3, 3, 4, 0]
    assert [rows[i].d_min for i in range(11)] == [0, 0, 1, 1, 1, 0, 2, 2, 2, 3, 0]
    assert [rows[i].src_max for i in range(11)] == [0, 1, 0, 0, 0, 5, 0, 0, 0, 0, 10]
    assert [rows[i].src_min for i in range(11)] == [0, 1, 0, 0, 1, 5, 1, 1, 1, 1, 10]


@pytest.mark.parametrize("one_task", [5_000_000, 0])
def test_snapshot_tables(micro, spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", one_task)
    nodes, edges = micro["nodes"], micro["edges"]
    sizes = components.size_series(nodes, edges).cache()
    evolved = snapshots.evolution(nodes, edges, half_years(spark))
    near = lambda x: pytest.approx(x, abs=1e-6)
    found = {r.chunk_id: (r.nodes, r.components, r.isolated, r.giant) for r in components.connectivity(sizes, evolved).collect()}
    assert found == {k: (v[0], v[2], v[3], v[4]) for k, v in SNAPSHOTS.items()}
    assert {r.chunk_id: r.arcs for r in evolved.collect()} == {k: v[1] for k, v in SNAPSHOTS.items()}
    into, out = snapshots.in_degree_dist(nodes, edges), snapshots.out_degree_dist(nodes, edges)
    tables = [(into, "degree", "freq"), (out, "degree", "freq"), (sizes, "size", "num_comp")]
    for i, t in enumerate(tables):
        assert {r.chunk_id: r.gini for r in stats.gini(*t).collect()} == {k: near(v[5 + i]) for k, v in SNAPSHOTS.items()}
        assert {r.chunk_id: r.ks for r in stats.ks_series(*t).collect()} == {k: near(v[4 + i]) for k, v in STEPS.items()}
    for i, (t, align) in enumerate([(tables[0], "value"), (tables[1], "value"), (tables[2], "rank"), (tables[2], "value")]):
        assert {r.chunk_id: r.hellinger for r in stats.hellinger_series(*t, align).collect()} == {k: near(v[i]) for k, v in STEPS.items()}
    full = {r.degree: r.freq for r in into.where("chunk_id = 4").collect()}
    assert full == {0: 4, 1: 6, 3: 1} and {r.degree: r.freq for r in out.where("chunk_id = 4").collect()} == {0: 5, 1: 4, 2: 1, 3: 1}


def test_self_spend_builds_and_depth_refuses(spark, tmp_path):
    g = built(spark, tmp_path, "1230768000,0,0::a;b\n1230768001,0,1:x,1,1,0:c;d\n")
    assert sorted((r.src, r.dst) for r in g["edges"].collect()) == [(2, 2), (2, 3)]
    with pytest.raises(Exception, match="does not rise"):
        depth.depths(g["nodes"], g["edges"]).collect()


def test_forward_reference_is_unresolved_and_three_colons(spark, tmp_path):
    g = built(spark, tmp_path, "1230768000,0,5:x,1,6,0:a:ignored;b\n1230768001,0,6::c\n")
    assert g["report"].first()["unresolved"] == 1 and g["nodes"].count() == 2


def test_empty_list(spark, tmp_path):
    g = built(spark, tmp_path, "\n")
    assert g["report"].first().asDict() == {"transactions": 0, "nodes": 0, "edges": 0, "duplicates": 0, "unresolved": 0}
    assert depth.depths(g["nodes"], g["edges"]).count() == 0
    assert components.wcc(g["nodes"], g["edges"]).count() == 0
    assert depth.summary(depth.depths(g["nodes"], g["edges"]), g["edges"]).first()["max_d_max"] is None


def test_calendar(spark):
    rows = half_years(spark).orderBy("chunk_id").collect()
    assert len(rows) == 28 and str(rows[0].end_date) == "2009-06-30 23:59:59" and str(rows[-1].end_date) == "2022-12-31 23:59:59"
    df = spark.createDataFrame([(1246406399,), (1246406400,), (1230767999,), (1672531200,)], "ts long")
    assert [r.c for r in df.select(chunk_of_epoch(F.col("ts")).alias("c")).collect()] == [1, 2, None, None]
    assert spark.range(1).select(label(F.lit(28))).first()[0] == "2022-H2"


def test_monotone_cursor(spark):
    rows = [(0, 1), (1, 2), (2, 1), (3, 3), (4, None), (5, 2)]
    df = spark.createDataFrame(rows, "seq long, chunk int")
    assert [(r.seq, r.chunk) for r in monotone_chunks(df, "seq", "chunk").orderBy("seq").collect()] == [(0, 1), (1, 2), (2, 2), (3, 3)]


def test_prefix_int_and_counts(spark):
    df = spark.createDataFrame([("12ab,x,+7,9:a,b,-3,4x;q:;;a;;b;;",), ("no,x:b,1:c",), ("1,2,-4::a",)], "value string")
    rows = transactions.parse(df.select(F.lit(0).alias("file_seq"), F.monotonically_increasing_id().alias("line_seq"), "value")).orderBy("line_seq").collect()
    assert len(rows) == 2
    assert (rows[0].ts, rows[0].tx_id, rows[0].out_count) == (12, 7, 5)
    assert [tuple(i) for i in rows[0].inputs] == [(-3, 4), (0, 0)]
    assert (rows[1].ts, rows[1].tx_id) == (0, 0)


def test_files_of_a_folder_are_read_by_name(spark, tmp_path):
    """Also where the later file is the larger one, which Spark reads first."""
    (tmp_path / "part-2.txt").write_text("".join(f"{i},0,{i},0::a,1,0\n" for i in range(500, 1500)))
    (tmp_path / "part-1.txt").write_text("".join(f"{i},0,{i},0::a,1,0\r\n" for i in range(500)))
    parsed = transactions.numbered(transactions.parse(transactions.read_lines(spark, [str(tmp_path)])))
    assert [r.tx_id for r in parsed.orderBy("read_seq").collect()] == list(range(1500))
    with pytest.raises(Exception, match="a line of [0-9]+ bytes in .*part-"):
        transactions.read_lines(spark, [str(tmp_path)], longest=12).collect()
