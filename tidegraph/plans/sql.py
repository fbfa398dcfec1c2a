"""The queries in SQL for DuckDB."""

from __future__ import annotations

GRAPH = """
tx AS MATERIALIZED (
  SELECT o_orderkey, o_orderdate AS created_at,
         row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS tx_id,
         ((year(o_orderdate) - 1995) * 2 + CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END)::INT AS chunk_id
  FROM orders),
nodes AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY tx_id, l_linenumber, l_partkey, l_suppkey, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS node_id,
         tx_id, chunk_id, created_at, l_partkey
  FROM lineitem JOIN tx ON l_orderkey = o_orderkey),
spendable AS (SELECT tx_id, l_partkey, max(node_id) AS last_node FROM nodes GROUP BY tx_id, l_partkey),
spent AS MATERIALIZED (
  SELECT tx_id, src FROM (SELECT tx_id, lag(last_node) OVER (PARTITION BY l_partkey ORDER BY tx_id) AS src FROM spendable)
  WHERE src IS NOT NULL),
inputs AS MATERIALIZED (SELECT DISTINCT tx_id, src FROM spent),
edges AS MATERIALIZED (SELECT i.src, n.node_id AS dst, n.chunk_id FROM inputs i JOIN nodes n USING (tx_id))"""

SNAPS = """,
k AS (SELECT unnest(range(1, 15))::INT AS chunk_id),
indeg AS MATERIALIZED (
  SELECT k.chunk_id, coalesce(d.n, 0) AS degree, count(*) AS freq
  FROM k JOIN nodes v ON v.chunk_id <= k.chunk_id
  LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) d ON d.dst = v.node_id GROUP BY ALL),
outn AS (SELECT k.chunk_id, src, count(*) AS n FROM k JOIN edges e ON e.chunk_id <= k.chunk_id GROUP BY ALL),
outdeg AS MATERIALIZED (
  SELECT k.chunk_id, coalesce(d.n, 0) AS degree, count(*) AS freq
  FROM k JOIN nodes v ON v.chunk_id <= k.chunk_id LEFT JOIN outn d ON d.src = v.node_id AND d.chunk_id = k.chunk_id GROUP BY ALL),
evo AS MATERIALIZED (
  SELECT k.chunk_id, (SELECT count(*) FROM nodes v WHERE v.chunk_id <= k.chunk_id) AS nodes,
         (SELECT count(*) FROM edges e WHERE e.chunk_id <= k.chunk_id) AS arcs FROM k)"""

#: A component can only change when an edge comes: labels of all snapshots at once, keyed by snapshot.
WCC = """,
und AS MATERIALIZED (SELECT k.chunk_id AS s, src AS a, dst AS b FROM k JOIN edges e ON e.chunk_id <= k.chunk_id
                     UNION SELECT k.chunk_id, dst, src FROM k JOIN edges e ON e.chunk_id <= k.chunk_id),
w(s, node_id, root) USING KEY (s, node_id) AS (
  SELECT k.chunk_id, node_id, node_id FROM k JOIN nodes v ON v.chunk_id <= k.chunk_id
  UNION
  SELECT u.s, u.b, min(w.root) FROM w JOIN und u ON w.node_id = u.a AND w.s = u.s
  LEFT JOIN recurring.w r ON r.node_id = u.b AND r.s = u.s WHERE w.root < r.root GROUP BY u.s, u.b),
sizes AS MATERIALIZED (
  SELECT s AS chunk_id, size, count(*) AS num_comp FROM (SELECT s, root, count(*) AS size FROM w GROUP BY s, root) GROUP BY ALL)"""

DEPTH = """,
dx(node_id, d_max) USING KEY (node_id) AS (
  SELECT node_id, 0 FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)
  UNION
  SELECT e.dst, max(d.d_max + 1) FROM dx d JOIN edges e ON d.node_id = e.src
  LEFT JOIN recurring.dx r ON r.node_id = e.dst WHERE r.d_max IS NULL OR d.d_max + 1 > r.d_max GROUP BY e.dst),
dn(node_id, d_min) USING KEY (node_id) AS (
  SELECT node_id, 0 FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)
  UNION
  SELECT e.dst, min(d.d_min + 1) FROM dn d JOIN edges e ON d.node_id = e.src
  LEFT JOIN recurring.dn r ON r.node_id = e.dst WHERE r.d_min IS NULL GROUP BY e.dst),
depth AS MATERIALIZED (SELECT node_id, d_max::BIGINT AS d_max, d_min::BIGINT AS d_min, chunk_id FROM dx JOIN dn USING (node_id) JOIN nodes USING (node_id))"""

ORIGIN = """,
px AS MATERIALIZED (SELECT e.dst, min(e.src) AS p FROM edges e JOIN depth a ON a.node_id = e.src JOIN depth b ON b.node_id = e.dst AND b.d_max = a.d_max + 1 GROUP BY e.dst),
pn AS MATERIALIZED (SELECT e.dst, min(e.src) AS p FROM edges e JOIN depth a ON a.node_id = e.src JOIN depth b ON b.node_id = e.dst AND b.d_min = a.d_min + 1 GROUP BY e.dst),
sx(node_id, src_max) AS (SELECT node_id, node_id FROM depth WHERE d_max = 0 UNION ALL SELECT px.dst, sx.src_max FROM sx JOIN px ON px.p = sx.node_id),
sn(node_id, src_min) AS (SELECT node_id, node_id FROM depth WHERE d_min = 0 UNION ALL SELECT pn.dst, sn.src_min FROM sn JOIN pn ON pn.p = sn.node_id)"""


def _norm(table: str, value: str, freq: str, align: str = "value", name: str = "p") -> str:
    key = value if align == "value" else f"row_number() OVER (PARTITION BY chunk_id ORDER BY {value})"
    return f",\n{name} AS MATERIALIZED (SELECT chunk_id, {key} AS k, {freq} / sum({freq}) OVER (PARTITION BY chunk_id) AS p FROM {table})"


def _hellinger(name: str = "p", column: str = "hellinger") -> str:
    return (
        f"SELECT b.chunk_id, round(sqrt(greatest(0, 1 - coalesce(sum(sqrt(a.p * b.p)), 0))), 6) AS {column} "
        f"FROM (SELECT chunk_id, k, p FROM {name}) b LEFT JOIN {name} a ON a.chunk_id = b.chunk_id - 1 AND a.k = b.k "
        f"WHERE b.chunk_id > 1 GROUP BY b.chunk_id"
    )


def _matrix(name: str = "p") -> str:
    return (
        f"SELECT x.chunk_id AS i, y.chunk_id AS j, round(CASE WHEN x.chunk_id = y.chunk_id THEN 0.0 ELSE sqrt(greatest(0, 1 - coalesce(c.c, 0))) END, 6) AS hellinger "
        f"FROM (SELECT DISTINCT chunk_id FROM {name}) x CROSS JOIN (SELECT DISTINCT chunk_id FROM {name}) y "
        f"LEFT JOIN (SELECT a.chunk_id AS i, b.chunk_id AS j, sum(sqrt(a.p * b.p)) AS c FROM {name} a JOIN {name} b USING (k) GROUP BY ALL) c ON c.i = x.chunk_id AND c.j = y.chunk_id"
    )


def _gini(table: str, value: str, freq: str, column: str = "gini") -> str:
    return (
        f"SELECT chunk_id, round(1 - 2 * sum((p - p0) * (l + l0) / 2), 6) AS {column} FROM (SELECT chunk_id, p, l, lag(p, 1, 0) OVER o AS p0, lag(l, 1, 0) OVER o AS l0, x FROM ("
        f"SELECT chunk_id, {value} AS x, sum({freq}) OVER (PARTITION BY chunk_id ORDER BY {value}) / sum({freq}) OVER (PARTITION BY chunk_id) AS p, "
        f"sum({value} * {freq}) OVER (PARTITION BY chunk_id ORDER BY {value}) / sum({value} * {freq}) OVER (PARTITION BY chunk_id) AS l FROM {table}) "
        f"WINDOW o AS (PARTITION BY chunk_id ORDER BY x)) GROUP BY chunk_id"
    )


def _ks(table: str, value: str, freq: str, column: str = "ks") -> str:
    return (
        f"SELECT i AS chunk_id, round(max(abs(g)), 6) AS {column} FROM (SELECT i, sum(d) OVER (PARTITION BY i ORDER BY v) AS g FROM ("
        f"SELECT i, v, sum(d) AS d FROM (SELECT chunk_id AS i, {value} AS v, {freq} / sum({freq}) OVER (PARTITION BY chunk_id) AS d FROM {table} "
        f"UNION ALL SELECT chunk_id + 1, {value}, -({freq} / sum({freq}) OVER (PARTITION BY chunk_id)) FROM {table}) GROUP BY ALL)) "
        f"WHERE i > 1 AND i <= (SELECT max(chunk_id) FROM {table}) GROUP BY i"
    )


def _graph(tail: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH}{''.join(parts)}\n{tail}"


def _dense(t: str) -> str:
    return _graph(
        f"SELECT m.chunk_id, m.degree::BIGINT AS degree, coalesce(d.freq, 0)::BIGINT AS freq FROM (SELECT chunk_id, unnest(range(0, max(degree) + 1)) AS degree FROM {t} GROUP BY chunk_id) m "
        f"LEFT JOIN {t} d USING (chunk_id, degree)", SNAPS)  # fmt: skip


def _pair(f, *extra: str) -> str:
    a, b = f("indeg", "in"), f("outdeg", "out")
    return _graph(f"SELECT * FROM ({a}) JOIN ({b}) USING (chunk_id)", SNAPS, *extra)


_COHORT = ", co AS (SELECT chunk_id, d_max AS d, count(*) AS freq, 'd_max' AS measure FROM depth GROUP BY ALL UNION ALL SELECT chunk_id, d_min, count(*), 'd_min' FROM depth GROUP BY ALL)"
_CO_MAX, _CO_MIN = "(SELECT * FROM co WHERE measure = 'd_max')", "(SELECT * FROM co WHERE measure = 'd_min')"


def _cohort_hellinger() -> str:
    norms, tails = "", []
    for m, t in (("d_max", _CO_MAX), ("d_min", _CO_MIN)):
        for align in ("rank", "value"):
            norms += _norm(t, "d", "freq", align, f"p_{m}_{align}")
            tails.append(f"SELECT chunk_id, '{m}' AS measure, '{align}' AS align, hellinger FROM ({_hellinger(f'p_{m}_{align}')})")
    return _graph(" UNION ALL ".join(tails), DEPTH, _COHORT, norms, recursive=True)


def _moments() -> str:
    one = lambda t, s: f"SELECT chunk_id, sum(freq)::BIGINT AS total, round(sum(freq * d) / sum(freq), 6) AS mean_{s}, round(sqrt(sum(freq * d * d) / sum(freq) - pow(sum(freq * d) / sum(freq), 2)), 6) AS std_{s} FROM {t} GROUP BY chunk_id"  # noqa: E731, E501
    return _graph(f"SELECT chunk_id, total, mean_max, std_max, mean_min, std_min FROM ({one(_CO_MAX, 'max')}) JOIN ({one(_CO_MIN, 'min')}) USING (chunk_id, total)", DEPTH, _COHORT, recursive=True)


_LABELS = "SELECT node_id, dense_rank() OVER (ORDER BY root) - 1 AS comp_id FROM w WHERE s = {k}"
_WIDE = ", ".join(f"max(CASE WHEN j = {k} THEN hellinger END) AS pg_{k}" for k in range(1, 15))
_END = "strftime(make_timestamp(1995 + (k.chunk_id // 2), CASE WHEN k.chunk_id % 2 = 1 THEN 7 ELSE 1 END, 1, 0, 0, 0) - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS end_date"
_share = lambda c: f"WITH RECURSIVE {GRAPH}{DEPTH} SELECT d, freq::BIGINT AS freq, round(sum(freq) OVER (ORDER BY d) / sum(freq) OVER (), 6) AS share FROM (SELECT {c} AS d, count(*) AS freq FROM depth GROUP BY 1)"  # noqa: E731, E501

ORACLE_SQL = {
    "chunk_calendar": f"SELECT k.chunk_id, (1995 + (k.chunk_id - 1) // 2) || '-H' || ((k.chunk_id - 1) % 2 + 1) AS label, strftime(make_timestamp(1995 + (k.chunk_id - 1) // 2, CASE WHEN k.chunk_id % 2 = 1 THEN 1 ELSE 7 END, 1, 0, 0, 0), '%Y-%m-%d %H:%M:%S') AS start_date, {_END} FROM (SELECT unnest(range(1, 15))::INT AS chunk_id) k",  # noqa: E501
    "chunk_split_counts": "SELECT CASE WHEN c BETWEEN 1 AND 10 THEN c ELSE -1 END::INT AS chunk_id, count(*) AS n_tx, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_ts FROM (SELECT o_orderdate AS t, (year(o_orderdate) - 1995) * 2 + CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS c FROM orders) GROUP BY 1",  # noqa: E501
    "tx_dedup": _graph("SELECT l_partkey AS tx_id, node_id AS read_seq, tx_id AS seen_in FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY node_id) AS r FROM nodes) WHERE r = 1"),
    "graph_nodes": _graph("SELECT node_id, tx_id, chunk_id, epoch(created_at)::BIGINT AS ts FROM nodes"),
    "graph_edges": _graph("SELECT src, dst, chunk_id FROM edges"),
    "build_from_text": _graph("SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM tx WHERE tx_id % 50 = 3) AS duplicates, (SELECT count(*) FROM tx WHERE tx_id % 100 = 7 AND tx_id IN (SELECT tx_id FROM nodes)) AS unresolved"),  # noqa: E501
    "build_edges_from_text": _graph("SELECT src, dst, chunk_id FROM edges"),
    "edges_sorted_distinct": _graph("SELECT DISTINCT s.src, n.node_id AS dst FROM spent s JOIN nodes n USING (tx_id) ORDER BY 1, 2"),
    "snapshot_evolution": _graph(f"SELECT k.chunk_id, nodes, arcs, round(arcs / nodes, 6) AS avg_in_degree, round(arcs / nodes, 6) AS avg_out_degree, {_END} FROM evo k", SNAPS),
    "node_growth": _graph("SELECT chunk_id, new_nodes FROM (SELECT chunk_id, nodes - lag(nodes) OVER (ORDER BY chunk_id) AS new_nodes FROM evo) WHERE new_nodes IS NOT NULL", SNAPS),
    "node_degrees": _graph("SELECT node_id, coalesce(i.n, 0)::BIGINT AS in_degree, coalesce(o.n, 0)::BIGINT AS out_degree FROM nodes LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i ON dst = node_id LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON src = node_id"),  # noqa: E501
    "in_degree_dist": _dense("indeg"),
    "out_degree_dist": _dense("outdeg"),
    "degree_gini": _pair(lambda t, s: _gini(t, "degree", "freq", f"gini_{s}")),
    "degree_hellinger": _graph(f"SELECT * FROM ({_hellinger('pi', 'hellinger_in')}) JOIN ({_hellinger('po', 'hellinger_out')}) USING (chunk_id)", SNAPS, _norm("indeg", "degree", "freq", name="pi"), _norm("outdeg", "degree", "freq", name="po")),  # noqa: E501
    "degree_ks": _pair(lambda t, s: _ks(t, "degree", "freq", f"ks_{s}")),
    "hellinger_matrix_in": _graph(_matrix(), SNAPS, _norm("indeg", "degree", "freq")),
    "hellinger_matrix_out": _graph(_matrix(), SNAPS, _norm("outdeg", "degree", "freq")),
    "hellinger_matrix_in_wide": _graph(f"SELECT 'pg_' || i AS graph, {_WIDE} FROM ({_matrix()}) GROUP BY i", SNAPS, _norm("indeg", "degree", "freq")),
    "powerlaw_alpha_closed_form": _graph("SELECT chunk_id, sum(freq)::BIGINT AS n, round(1 + sum(freq) / sum(freq * ln(degree / 1.5)), 6) AS alpha FROM indeg WHERE degree >= 2 GROUP BY chunk_id", SNAPS),
    "wcc_labels": _graph(_LABELS.format(k=1), SNAPS.replace("range(1, 15)", "range(1, 2)"), WCC, recursive=True),
    "wcc_labels_full": _graph(_LABELS.format(k=14), SNAPS.replace("range(1, 15)", "range(14, 15)"), WCC, recursive=True),
    "wcc_size_dist": _graph("SELECT chunk_id, size::BIGINT AS size, num_comp::BIGINT AS num_comp FROM sizes", SNAPS, WCC, recursive=True),
    "wcc_connectivity": _graph("SELECT chunk_id, nodes, components, giant, isolated, round(giant * 100.0::DOUBLE / nodes, 6) AS coverage, round(isolated * 100.0::DOUBLE / nodes, 6) AS isolated_pct FROM evo JOIN (SELECT chunk_id, sum(num_comp)::BIGINT AS components, max(size)::BIGINT AS giant, coalesce(sum(num_comp) FILTER (size = 1), 0)::BIGINT AS isolated FROM sizes GROUP BY chunk_id) USING (chunk_id)", SNAPS, WCC, recursive=True),  # noqa: E501
    "wcc_hellinger": _graph(f"SELECT * FROM ({_hellinger('pr', 'by_rank')}) JOIN ({_hellinger('pv', 'by_value')}) USING (chunk_id)", SNAPS, WCC, _norm("sizes", "size", "num_comp", "rank", "pr"), _norm("sizes", "size", "num_comp", "value", "pv"), recursive=True),  # noqa: E501
    "wcc_gini": _graph(_gini("sizes", "size", "num_comp"), SNAPS, WCC, recursive=True),
    "wcc_ks": _graph(_ks("sizes", "size", "num_comp"), SNAPS, WCC, recursive=True),
    "hellinger_matrix_wcc": _graph(_matrix(), SNAPS, WCC, _norm("sizes", "size", "num_comp", "rank"), recursive=True),
    "depth_min": _graph("SELECT node_id, d_min FROM depth", DEPTH, recursive=True),
    "depth_max": _graph("SELECT node_id, d_max FROM depth", DEPTH, recursive=True),
    "depth_sources": _graph("SELECT node_id, src_max, src_min FROM sx JOIN sn USING (node_id)", DEPTH, ORIGIN, recursive=True),
    "depth_summary": _graph("SELECT count(*) AS nodes, count(*) FILTER (d_max = 0) AS sources, max(d_max) AS max_d_max, arg_min(node_id, -d_max * 10000000000 + node_id) AS deepest, arg_min(src_max, -d_max * 10000000000 + node_id) AS deepest_source, round(avg(d_max), 6) AS mean_d_max, max(d_min) AS max_d_min, round(avg(d_min), 6) AS mean_d_min, (SELECT count(*) FROM edges) AS arcs FROM depth JOIN sx USING (node_id)", DEPTH, ORIGIN, recursive=True),  # noqa: E501
    "depth_dist_max": _graph("SELECT d_max AS d, count(*) AS freq FROM depth GROUP BY 1", DEPTH, recursive=True),
    "depth_dist_min": _graph("SELECT d_min AS d, count(*) AS freq FROM depth GROUP BY 1", DEPTH, recursive=True),
    "depth_cumulative_max": _share("d_max"),
    "depth_cumulative_min": _share("d_min"),
    "depth_top_sources": _graph("SELECT src_max AS source, count(*) AS nodes FROM sx GROUP BY 1", DEPTH, ORIGIN, recursive=True),
    "depth_cohort_dist": _graph("SELECT chunk_id, d, freq, measure FROM co", DEPTH, _COHORT, recursive=True),
    "depth_cohort_moments": _moments(),
    "depth_cohort_hellinger": _cohort_hellinger(),
    "depth_cohort_matrix": _graph(f"SELECT i, j, hellinger, 'd_max' AS measure FROM ({_matrix('px2')}) UNION ALL SELECT i, j, hellinger, 'd_min' FROM ({_matrix('pn2')})", DEPTH, _COHORT, _norm(_CO_MAX, "d", "freq", "rank", "px2"), _norm(_CO_MIN, "d", "freq", "rank", "pn2"), recursive=True),  # noqa: E501
    "distance_exact": _graph("SELECT d::BIGINT AS distance, count(*) AS pairs FROM bfs GROUP BY d", ", e1 AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE chunk_id <= 1), bfs(a, b, d) USING KEY (a, b) AS (SELECT src, dst, 1 FROM e1 UNION SELECT f.a, e.dst, min(f.d + 1) FROM bfs f JOIN e1 e ON f.b = e.src LEFT JOIN recurring.bfs r ON r.a = f.a AND r.b = e.dst WHERE r.d IS NULL AND f.a <> e.dst GROUP BY f.a, e.dst)", recursive=True),  # noqa: E501
    "depth_blocks": _graph("SELECT node_id, d_max, d_min, src_max, src_min FROM depth JOIN sx USING (node_id) JOIN sn USING (node_id)", DEPTH, ORIGIN, recursive=True),
    "wcc_size_dist_rounds": _graph("SELECT chunk_id, size::BIGINT AS size, num_comp::BIGINT AS num_comp FROM sizes", SNAPS, WCC, recursive=True),
    "cursor_chunks": _graph(
        "SELECT m::INT AS chunk_id, count(*) AS nodes, min(node_id) AS first_node, max(node_id) AS last_node FROM ("
        "SELECT node_id, max(CASE WHEN c BETWEEN 1 AND 10 THEN c ELSE 1000 END) OVER (ORDER BY node_id) AS m FROM ("
        "SELECT node_id, (year(t) - 1995) * 2 + CASE WHEN month(t) <= 6 THEN 1 ELSE 2 END AS c FROM ("
        "SELECT node_id, greatest(CASE WHEN node_id % 5 = 0 THEN created_at::TIMESTAMP - INTERVAL 40 DAYS ELSE created_at::TIMESTAMP END, TIMESTAMP '1995-01-01') AS t FROM nodes))) WHERE m < 1000 GROUP BY 1"
    ),
    "snapshot_evolution_even": _graph("SELECT chunk_id, nodes, arcs FROM evo WHERE chunk_id % 2 = 0", SNAPS),
    "views_edges_by_chunk": _graph("SELECT k.chunk_id, count(e.src) AS arcs, count(DISTINCT e.dst) AS targets FROM (SELECT unnest(range(1, 15))::INT AS chunk_id) k LEFT JOIN edges e USING (chunk_id) GROUP BY 1"),
    "degree_file": _dense("indeg").replace("SELECT m.chunk_id, m.degree", "SELECT m.degree") + " WHERE m.chunk_id = 14",
    "stats_file": _graph("SELECT unnest(['chunk_id', 'nodes', 'arcs']) AS key, unnest([chunk_id::BIGINT, nodes, arcs]) AS value FROM evo WHERE chunk_id = 14", SNAPS),
    "edges_table_file": _graph("SELECT src, dst, chunk_id FROM edges"),
    "edges_packed": _graph("SELECT src, dst, chunk_id FROM edges"),
    "components_file": _graph(f"SELECT row_number() OVER (ORDER BY node_id) - 1 AS node_rank, comp_id FROM ({_LABELS.format(k=1)})", SNAPS.replace("range(1, 15)", "range(1, 2)"), WCC, recursive=True),
}
