"""Repeated strings against all windows of all texts."""

import hashlib
from collections import Counter

import numpy as np

from tidegraph.llm import suffixes

SCHEMA = "doc_id long, text string, h1 long, spans string"


def brute(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[p : p + 200] for _, b in data for p in range(len(b) - 199))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        runs = int(np.diff(np.concatenate([[0], gone.view(np.int8)])).clip(0).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, **sizes):
    return sorted((tuple(r) for r in suffixes.digest(df, **sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_planted_repeats(spark):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdefgh üß"), n))
    base = text(1500)
    rows = [(0, base), (1, base[:700] + "X" + base[701:]), (2, text(90) + base[300:499] + text(90)), (3, text(50) + base[300:560] + text(60) + base[900:1200])]
    rows += [(4, base), (5, "a" * 450), (6, "ab" * 300), (7, None), (8, ""), (9, base[:150]), (10, text(3000))]
    rows += [(11, base[100:299] + text(10) + base[100:310]), (12, base[1300:] + text(5)), (13, text(5) + base[1299:]), (None, base[200:650]), (14, text(240)), (14, text(240))]
    for k in range(20):
        piece = list(base)
        for at in rng.integers(0, len(base), 5):
            piece[at] = "Z"
        rows.append((20 + k, "".join(piece)))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    assert result(df) == brute(rows)
    # Many parts and many ranges of the order give the same.
    assert result(df, part_bytes=1000, range_keys=400) == brute(rows)
    out = suffixes.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)


def test_empty_and_short(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert result(empty) == []
    rows = [(1, "a" * 199), (2, "a" * 199), (3, "é" * 100), (4, "é" * 100)]
    assert result(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)) == brute(rows)


def test_documents_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = suffixes.op6_suffix_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_keys_of_one_hash(monkeypatch):
    """Ranks are exact: keys that share a hash are told apart."""
    monkeypatch.setattr(suffixes._text, "mix", lambda x: x & np.uint64(1))
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(3)]
    order, first, _ = suffixes._order(columns)
    keys = list(zip(*(c.tolist() for c in columns), strict=True))
    assert len(first) == len(set(keys)) and sorted(order) == list(range(500))
    for a, b in zip(first, [*first[1:], 500], strict=True):
        assert len({keys[i] for i in order[a:b]}) == 1


def test_names_of_clashing_columns_and_a_long_text(spark):
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefgh "), 1_300_000))
    rows = [(1, long, "p"), (2, long[500_000:500_300], "q"), (3, None, None), (3, None, None), (4, "é" * 150, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string").selectExpr("*", "1 AS h2", "2 AS holders", "3 AS kept", "4 AS row", "5 AS t", "6 AS _h1", "7 AS _kept")
    got = {r.doc_id: r for r in suffixes.digest(df).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[3].n_bytes, got[4].n_removed) == (300, 1, 300, 0, 300)
    out = suffixes.remove_repeats(df)
    assert out.columns == df.columns
    kept = {r.doc_id: (r.text, r.h1, r.kept, r.row) for r in out.collect()}
    assert kept[1] == (long[:500_000] + long[500_300:], "p", 3, 4) and kept[2][0] == "" and kept[4][0] == ""
