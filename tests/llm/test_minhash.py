"""Near-dedup against all pairs of full shingle sets."""

import re

import numpy as np
from pyspark.sql import functions as F

from tidegraph.llm import minhash

SCHEMA = "doc_id long, text string, source string, component_id string, u long"


def brute(rows):
    sets = {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}


def test_all_pairs_on_chains_and_groups(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for _ in range(6):
        base = [words[i] for i in rng.integers(0, 400, 90)]
        for step in range(14):  # each a few words from the last: chains and stars
            if step % 3:
                base = list(base)
                base[int(rng.integers(0, 90))] = words[int(rng.integers(0, 400))]
            rows.append((doc * 7 % 997, " ".join(base).upper() if step % 5 == 4 else "\n".join(base)))
            doc += 1
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "one two"), (2004, "ONE  two"), (2005, "two one"), (2006, "x " * 300), (2007, "x " * 5)]
    df = spark.createDataFrame([(d, t, "s", "x", 1) for d, t in rows], SCHEMA)
    got, want = result(df), brute(rows)
    assert got == want
    assert got[2004][1] == 2003 and got[2007][1] == 2006


def test_hub_that_matches_nobody(spark, monkeypatch):
    """The left-over classes meet when star rounds end early."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    rng = np.random.default_rng(1)
    core = [f"c{i}" for i in range(60)]
    rows = [(0, " ".join(core + [f"z{i}" for i in range(30)]))]
    for k in range(1, 12):
        own = list(core) + [f"k{i}" for i in range(12)]
        own[int(rng.integers(0, 60))] = f"n{k}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame([(d, t, "s", "x", 1) for d, t in rows], SCHEMA)
    assert result(df) == brute(rows)


def test_families_that_one_link_chains(spark, monkeypatch):
    """The hub of all buckets that x and y share links with x only: the one link of y is left to the final join."""
    monkeypatch.setattr(minhash, "FEW_MEETINGS", 0)

    def put(words, at, size, tag):
        return [*words[:at], *[f"{tag}_{i}" for i in range(size)], *words[at + size :]]

    x = [f"x928_{i}" for i in range(100)]
    hub = put(x, 38, 9, "a38")
    texts = [x, put(x, 0, 13, "y"), hub, *[put(hub, 42, 1, f"k38_{k}") for k in range(12)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, "s", "x", 1) for d, t in rows], SCHEMA)
    want = brute(rows)
    assert {c for _, c in want.values()} == {0}
    assert result(df) == want


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f", None, None, None), (None, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, 1), (3, "a b c d e f", None, None, 1)], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (3, 3, True), (3, 3, True)]


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op2_minhash_dedup(spark, "/root/testdata/sf0.001").collect()} == brute(rows)
    assert docs.agg(F.count("doc_id")).first()[0] == len(rows)


def test_document_with_rows_of_several_texts(spark):
    """A repeated doc_id has the links of all its rows, whatever other columns are called."""
    rng = np.random.default_rng(8)
    a, b = ([f"{k}{i}" for i in rng.integers(0, 300, 120)] for k in "ab")
    near = lambda t: [*t[:-2], "other", "end"]
    rows = [(3, a), (3, b), (5, near(a)), (7, near(b)), (8, ["alone", "here", "with", "six", "words", "only"]), (9, a), (3, a), (10, rng.integers(0, 10**6, 150_000).astype(str).tolist())]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string").selectExpr("*", *[f"1 AS {c}" for c in ("x", "d1", "d2", "u", "v", "rep", "grams", "size", "component", "node", "label")])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == sorted((d, 3 if d in (3, 5, 7, 9) else d, d in (3, 8, 10)) for d, _ in rows)
