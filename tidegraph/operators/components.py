"""Weakly connected components: contraction in every task, then one task or alternating large-star and small-star.

Each task first replaces pieces of its edges by a spanning forest of them.  Where an array over all
node ids fits a task, one task then unites these forests as they stream by, in the order of their
chunks; it holds a few bytes an id and no edges.  Larger graphs go by stars: every round rewires edges towards the smallest id seen, so the number of rounds
grows with the logarithm of the diameter and no adjacency list is ever gathered
in one task: a vertex' smallest neighbour is a (map-side combined) ``min``, and
it returns to the edges by a join whose hot keys adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch

MAX_ROUNDS = 60
#: Edges contracted together, and ids in a packed row.
PIECE, PACK = 1_000_000, 1 << 17


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = scratch.materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = scratch.materialize(down.groupBy("u").agg(F.min("v").alias("m")), "low")
    kept = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return kept.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _roots(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The roots of ``x``, to which its entries point from now on."""
    while True:
        up = label[x]
        top = label[up]
        if (up == top).all():
            return up
        label[x] = top


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the ends of edges in a label array, smallest id first, all edges in step; the roots that are none any more."""
    gone = [np.zeros(0, np.int64)]
    while True:
        a, b = _roots(label, a), _roots(label, b)
        open_ = a != b
        a, b = a[open_], b[open_]
        if not len(a):
            return np.concatenate(gone)
        high = np.maximum(a, b)
        np.minimum.at(label, high, np.minimum(a, b))
        gone.append(np.unique(high))


def _contract(u: np.ndarray, v: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewer edges that join, of those of every ``k`` and all lower ones, the same vertices; in the order of ``k``."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(ids), dtype=np.int32)
    order = np.argsort(k, kind="stable")
    a, b, k = place[: len(u)][order], place[len(u) :][order], k[order]
    out = []
    for start, end in zip(first := np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), [*first[1:], len(k)]):
        gone = _merge(label, a[start:end], b[start:end])
        out.append((ids[gone], ids[_roots(label, gone)], np.full(len(gone), k[start], np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of about ``PIECE`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PIECE:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, n = [], 0
    if n:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


PACKED = "k int, kind int, a binary, b binary"


def _pack(u: np.ndarray, v: np.ndarray | None, k: np.ndarray, low: int) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``PACK`` ids above ``low`` and of one ``k``; edges are of kind 0, nodes of kind 1 with no ``b``."""
    for start, end in zip(first := np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), [*first[1:], len(k)]):
        for i in range(start, end, PACK):
            j = min(end, i + PACK)
            a, b = ((u[i:j] - low).astype(np.int32).tobytes(), b"" if v is None else (v[i:j] - low).astype(np.int32).tobytes())
            row = [pa.array([int(k[start])], pa.int32()), pa.array([int(v is None)], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names=["k", "kind", "a", "b"])


def contracted(edges: DataFrame) -> DataFrame:
    """``(u, v)``: edges of the same components as ``(u, v)`` given, without nulls; pieces of a task's edges become forests."""
    def run(batches):
        for u, v in _pieces(batches):
            u, v, _ = _contract(u, v, np.zeros(len(u), np.int32))
            for i in range(0, len(u), PACK):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + PACK]), pa.array(v[i : i + PACK])], names=["u", "v"])

    scratch.ship_package(edges.sparkSession)
    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _packed(nodes: DataFrame, edges: DataFrame, low: int) -> DataFrame:
    """All nodes ``(id, k)`` and the contracted edges ``(u, v, k)`` in one partition, in the order of ``k``, edges first."""
    def pack_edges(batches):
        for u, v, k in _pieces(batches):
            yield from _pack(*_contract(u, v, k), low)

    def pack_nodes(batches):
        for u, k in _pieces(batches):
            order = np.argsort(k, kind="stable")
            yield from _pack(u[order], None, k[order], low)

    rows = edges.mapInArrow(pack_edges, PACKED).unionByName(nodes.mapInArrow(pack_nodes, PACKED))
    return rows.repartition(1).sortWithinPartitions("k", "kind")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            k, kind, a, b = (batch.column(c)[i] for c in range(4))
            yield k.as_py(), kind.as_py(), np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(b.as_buffer(), np.int32)


def _sizes_in_order(span: int, last: int):
    """Component sizes of the snapshots up to ``last``, from the rows of :func:`_packed`."""
    def run(batches):
        label, size, now = np.arange(span, dtype=np.int32), np.zeros(span, np.int32), 1

        def snapshot(k):
            value, count = np.unique(size[size > 1], return_counts=True)
            ones = np.count_nonzero(size == 1)
            value, count = np.r_[[1] * bool(ones), value], np.r_[[ones] * bool(ones), count]
            columns = [pa.array(np.full(len(value), k), pa.int32()), pa.array(value, pa.int64()), pa.array(count, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk_id", "size", "num_comp"])

        for k, kind, a, b in _unpack(batches):
            while now < k:
                yield snapshot(now)
                now += 1
            if kind:
                np.add.at(size, _roots(label, a), 1)
            else:
                gone = _merge(label, a, b)
                np.add.at(size, _roots(label, gone), size[gone])
                size[gone] = 0
        for k in range(now, last + 1):
            yield snapshot(k)

    return run


def _numbers_in_order(span: int):
    """Packed ``(id, number)`` of all nodes, components numbered in the order of their first node."""
    def run(batches):
        label, present = np.arange(span, dtype=np.int32), np.zeros(span, bool)
        for _, kind, a, b in _unpack(batches):
            if kind:
                present[a] = True
            else:
                _merge(label, a, b)
        slices = [slice(i, i + PACK) for i in range(0, span, PACK)]
        for s in slices:  # roots have the lowest ids, so what lies before is done
            _roots(label, np.arange(s.start, min(s.stop, span)))
        places = lambda s: np.flatnonzero(present[s]) + s.start
        if not all(present[label[s]][present[s]].all() for s in slices):  # a root that is no node: the first node takes its place
            first = np.full(span, span, np.int32)
            for at in map(places, slices):
                np.minimum.at(first, label[at], at.astype(np.int32))
            for at in map(places, slices):
                label[at] = first[label[at]]
        n = 0
        for at in map(places, slices):  # from here on labels are numbers; those of lower ids are done
            root = label[at]
            own = root == at
            label[at[own]] = np.arange(n, n + np.count_nonzero(own))
            n += np.count_nonzero(own)
            label[at[~own]] = label[root[~own]]
            yield from _pack(at, label[at], np.zeros(len(at), np.int32), 0) if len(at) else ()

    return run


def _ids(nodes: DataFrame, edges: DataFrame) -> tuple[int, int, int]:
    """The lowest id of nodes and edges, the span up to the highest, and the number of edges."""
    n = nodes.agg(F.min("node_id"), F.max("node_id")).first()
    e = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst")), F.count(F.lit(1))).first()
    known = [x for x in (*n, *e[:2]) if x is not None]
    return min(known, default=0), max(known, default=-1) - min(known, default=0) + 1, e[2]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every vertex that lies on an edge.

    ``component`` is the smallest vertex id reachable, edges taken both ways.
    Null ends, self-loops and repeated edges are allowed; vertices found only on
    such edges of one end do not appear.  No edges give an empty result.
    """
    now = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    loops = now.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    now = scratch.materialize(contracted(now.where("u <> v")).distinct(), "edges")
    mark = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        now = scratch.materialize(_small_star(_large_star(now)), "edges")
        new = _fingerprint(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not converge")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return labels.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


#: Edges and span of ids up to which one task unites what the contraction leaves; it holds 9 bytes an id.
ONE_TASK_EDGES, ONE_TASK_IDS = 400_000_000, 50_000_000


def renumbered(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(node_id, comp_id)``: components 0, 1, ... in the order of their first node; isolated nodes included."""
    from tidegraph.operators.numbering import positions

    root = nodes.select("node_id").join(labels, nodes["node_id"] == labels["node"], "left").select("node_id", F.coalesce("component", "node_id").alias("root"))
    ids = positions(root.where("root = node_id").select("root"), ["root"], "comp_id")
    return root.join(ids, "root").select("node_id", "comp_id")


def wcc(nodes: DataFrame, edges: DataFrame, one_task_edges: int | None = None) -> DataFrame:
    """``(node_id, comp_id)`` of a graph, direction ignored; nodes have distinct ids."""
    low, span, count = _ids(nodes, edges)
    if count > (ONE_TASK_EDGES if one_task_edges is None else one_task_edges) or span > ONE_TASK_IDS or not span:
        return renumbered(nodes, connected_components(edges))
    spark = nodes.sparkSession
    scratch.ship_package(spark)
    k = F.lit(1).alias("k")
    ends = edges.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"), k)
    rows = _packed(nodes.select(F.col("node_id").cast("long").alias("u"), k), ends, low)
    numbers = rows.mapInArrow(_numbers_in_order(span), PACKED)  # by a shuffle, as Parquet would be read back in batches of all rows

    def run(batches):
        for _, _, a, b in _unpack(batches):
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64) + low), pa.array(b.astype(np.int64))], names=["node_id", "comp_id"])

    return numbers.repartition(max(1, -(-span // (8 * PACK))), F.xxhash64("a")).mapInArrow(run, "node_id long, comp_id long")


def size_distribution(labels: DataFrame) -> DataFrame:
    """``(size, num_comp)`` from ``(node_id, comp_id)``."""
    return labels.groupBy("comp_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("num_comp"))


def size_series(nodes: DataFrame, edges: DataFrame, one_task_edges: int | None = None) -> DataFrame:
    """``(chunk_id, size, num_comp)`` of every cumulative snapshot.

    A snapshot's components come from the last one's: only new edges, taken between the
    components they join, are contracted.  Where what the contraction leaves goes to one task, that takes
    all snapshots in turn: nodes count from their chunk on.
    """
    low, span, count = _ids(nodes, edges)
    last = nodes.agg(F.max("chunk_id")).first()[0] or 0
    if count <= (ONE_TASK_EDGES if one_task_edges is None else one_task_edges) and span <= ONE_TASK_IDS:
        scratch.ship_package(nodes.sparkSession)
        born = nodes.where("chunk_id IS NOT NULL").select(F.col("node_id").cast("long").alias("u"), F.greatest("chunk_id", F.lit(1)).cast("int").alias("k"))
        ends = edges.where((F.col("chunk_id") >= 1) & (F.col("chunk_id") <= last)).where("src is not null and dst is not null")
        ends = ends.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"), F.col("chunk_id").cast("int").alias("k"))
        return _packed(born, ends, low).mapInArrow(_sizes_in_order(span, last), "chunk_id int, size long, num_comp long")
    labels, out = None, None
    for k in range(1, last + 1):
        new = nodes.where(F.col("chunk_id") == k).select("node_id", F.col("node_id").alias("root"))
        labels = new if labels is None else labels.unionByName(new)
        fresh = edges.where(F.col("chunk_id") == k)
        joined = fresh.join(labels.select(F.col("node_id").alias("src"), F.col("root").alias("u")), "src").join(labels.select(F.col("node_id").alias("dst"), F.col("root").alias("v")), "dst")
        parts = connected_components(joined.select("u", "v").distinct(), "u", "v")
        labels = labels.join(parts, labels["root"] == parts["node"], "left").select("node_id", F.coalesce("component", "root").alias("root"))
        labels = scratch.materialize(labels, f"labels{k}")
        sizes = size_distribution(labels.withColumnRenamed("root", "comp_id")).select(F.lit(k).alias("chunk_id"), "size", "num_comp")
        sizes = scratch.materialize(sizes, "sizes")
        out = sizes if out is None else out.unionByName(sizes)
    return out


def connectivity(sizes: DataFrame, evolved: DataFrame) -> DataFrame:
    """Giant component, isolated nodes and their shares, per snapshot."""
    rows = sizes.groupBy("chunk_id").agg(
        F.sum("num_comp").alias("components"), F.max("size").alias("giant"), F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("num_comp"))), F.lit(0)).alias("isolated")
    )
    rows = evolved.select("chunk_id", "nodes").join(rows, "chunk_id", "left")
    share = lambda c: F.try_divide(F.col(c) * F.lit(100.0), F.col("nodes"))
    return rows.select("chunk_id", "nodes", "components", "giant", "isolated", share("giant").alias("coverage"), share("isolated").alias("isolated_pct"))
