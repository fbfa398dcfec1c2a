"""Roles recovered, and blocks against one piece."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tidegraph.llm import transcripts as T

SCHEMA = "conv_id long, turn int, role string, text string, conv string, block int"


def test_markers():
    assert T.marker("User: hi") == (1, "hi") and T.marker("### Assistant:") == (2, "")
    assert T.marker("<|system|>") == (0, "") and T.marker("[Human] ok") == (1, "ok")
    assert T.marker("A longer line: of text")[0] == -1 and T.marker("")[0] == -1


def _text(rng):
    """A transcript of random lines: markers, questions, blanks, plain words."""
    kinds = ["User: ", "Assistant: ", "### System:", "", "", "", "Context: ", "Q: "]
    lines = []
    for i in range(int(rng.integers(1, 13))):
        lines.append("" if rng.random() < 0.3 else kinds[int(rng.integers(0, 8))] + f"w{i}" + "?" * int(rng.integers(0, 2)))
    return lines


def test_blocks_decode_like_one_piece(spark):
    """Random transcripts cut into rows anywhere; blocks of every size give what one block gives."""
    rng = np.random.default_rng(5)
    rows = []
    for c in range(300):
        lines = _text(rng)
        cuts = sorted(set(rng.integers(1, len(lines), int(rng.integers(0, 5))).tolist())) if len(lines) > 1 else []
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
            rows.append((f"c{c}", k, "\n".join(lines[a:b])))
    rows += [("hot", i, ("User: q%d" if i % 2 == 0 else "Assistant: a%d") % i if i % 5 else "\nplain %d?" % i) for i in range(40)]
    rows += [("hot2", 0, f"line {i:03d}" if i else "System: many rows of one turn") for i in range(90)]
    raw = spark.createDataFrame(rows, "conv string, turn long, raw string")
    take = lambda **k: sorted(tuple(r) for r in T.recover(raw, **k).collect())
    whole = take(size=1000)
    assert len(whole) > 300
    for sizes in ({"size": 1}, {"size": 2}, {"size": 7}, {"size": 1000, "most": 20}):
        assert take(**sizes) == whole
    assert max(T.blocks_of(raw, 7).selectExpr("size(items) AS n").collect()).n == 7


def test_decoding_is_the_best_path():
    """Against all paths of short transcripts."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        seen = T._observe([x for x in _text(rng) if x][:5], True)[0]
        if not len(seen):
            continue
        score = lambda p: T.START[p[0]] + seen[0, p[0]] + sum(T.TRANSITIONS[a, b] + seen[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))
        best = max(score(p) for p in itertools.product(range(T._N), repeat=len(seen)))
        assert score(T.decode(seen, None, np.zeros(T._N, np.int64)).tolist()) == best


def test_roles_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = T.op7_chat_format(spark, "/root/testdata/sf0.01").withColumnRenamed("role", "found")
    both = table.join(got, ["conv_id", "turn"])
    right = both.agg(F.avg((F.col("role") == F.col("found")).cast("double"))).first()[0]
    assert right > 0.97
    assert both.count() >= 0.98 * table.count()


def test_turns_keep_their_lines(spark):
    reply = "first\n\n  indented\nContext: inner words\nlast "
    raw = spark.createDataFrame([("c", 0, "User: go?"), ("c", 1, "Assistant: " + reply), ("c", 2, "User: thanks\n\n")], "conv string, turn long, raw string")
    want = [(0, "user", "go?"), (1, "assistant", reply), (2, "user", "thanks")]
    got = T.recover(raw).orderBy("turn", "line").collect()
    assert [(r.turn, r.role, r.text) for r in got] == want and got[1].rendered == T.canonical("assistant", reply)


def test_edges(spark):
    rows = [(1, 0, "user", "hi", "x", 1), (1, 0, "user", "hi", "x", 1), (1, 1, "assistant", None, None, None), (None, 0, "user", "lost", "y", 2), (2, None, "system", "rule", "z", 3), (3, 0, None, "", "z", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.conv, r.role, r.text) for r in T.recover(T.raw_turns(df)).collect())
    assert sorted(x[1:] for x in got) == [("assistant", ""), ("system", "rule"), ("user", "hi"), ("user", "lost")]
    assert T.recover(T.raw_turns(df.limit(0))).count() == 0
