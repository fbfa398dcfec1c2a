"""Items found against full dynamic programming."""

import tracemalloc

import numpy as np

from tidegraph.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id string, edits int"
ITEMS = "item_id long, text string, doc_id long"


def norm(s):
    return " ".join((s or "").lower().split())


def best(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_planted_edits(spark):
    rng = np.random.default_rng(2)
    letters = list("abcdefghij   klmnñüé.")
    text = lambda n: "".join(rng.choice(letters, n)).strip() or "x"
    items = [(i, text(int(rng.integers(60, 160)))) for i in range(8)] + [(8, "short"), (9, None), (10, ""), (11, " Sho  rt ")]
    docs = []
    for d in range(60):
        body = items[d % 8][1]
        for _ in range(d // 8):  # 0 to 7 edits
            at = int(rng.integers(0, len(body)))
            body = (body[:at] + "Q" + body[at + 1 :], body[:at] + body[at + 1 :], body[:at] + "zz" + body[at:])[d % 3]
        docs.append((d, text(50) + "\n\t " + (body.upper() if d % 4 == 0 else body.replace(" ", " \n")) + " " + text(40)))
    docs += [(103, "a short line\n sho\t RT\nend"), (104, "SHORT"), (105, "not sho rt")]
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = sorted((r.doc_id, r.item_id, r.edits) for r in D.leaks(df, bench).collect())
    known = D.Items(items)
    want = []
    for d, t in docs:
        for i, k in zip(known.ids, known.k.tolist()):
            if len(norm(dict(items)[i])) < D.Q:  # whole lines
                want += [(d, i, 0)] if norm(dict(items)[i]) in [norm(x) for x in (t or "").split("\n")] else []
                continue
            e = best(norm(dict(items)[i]), norm(t))
            if e <= k:
                want.append((d, i, e))
    assert got == sorted(want) and any(e > 0 for _, _, e in want)
    assert sorted(r.doc_id for r in D.clean(df, bench).collect()) == sorted(d for d, _ in docs if d not in {x[0] for x in want})


def test_edits_that_lie_close_together():
    """An item with a short one in its block: most of its edits lie close together, its sparse hits count too."""
    rng = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    short, long = "".join(rng.choice(letters, 81)), "".join(rng.choice(letters, 394))
    items = D.Items([(1, short), (2, long)])
    for extra in ((270, 300, 330, 360), (275, 285, 380, 390), (260, 262, 264, 390)):
        text = list(long)
        for at in [5 + 14 * i for i in range(18)] + list(extra):
            text[at] = "Ω"
        points = np.frombuffer(("0" * 600 + "".join(text) + "1" * 600).encode("utf-32-le"), np.uint32)
        assert [(i, e) for _, i, e, _, _ in D.search(items, points, np.array([0, len(points)]))] == [(1, 22)]


def test_short_items_are_searched_exactly():
    words = ["capital city", "who wrote hamlet", "what is 17 times three"]
    items = D.Items([*enumerate(words), (9, "too short")])
    text = "Z. CAPITAL  City; who wrote hamlet? who wrote hamlex, what is 17 times three"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    assert [(items.ids[i], e) for _, i, e, _, _ in D.search(items, points, np.array([0, len(points)]))] == [(0, 0), (1, 0), (2, 0)]
    line = np.frombuffer("one\n  Too\t SHORT \nthree too short".encode("utf-32-le"), np.uint32)
    assert D.search(items, line, np.array([0, len(line)])) == [(0, 3, 0, 6, 16)]
    miss = np.frombuffer(b"w\0\0\0", np.uint32)
    assert D.search(items, miss, np.array([0, 1])) == []


def test_places_and_empty_tables(spark):
    item = "The  quick brown fox jumps over the lazy dog again"
    df = spark.createDataFrame([(1, "Ünïcode  " + item + "!", "x", 1)], DOCS)
    bench = spark.createDataFrame([(5, item, 1)], ITEMS)
    r = D.leaks(df, bench).first()
    assert (r.item_id, r.edits, r.start, r.end) == (5, 0, 9, 9 + len(item))
    assert D.leaks(df.limit(0), bench).count() == 0 and D.leaks(df, bench.limit(0)).count() == 0
    assert D.clean(df, bench.limit(0)).count() == 1


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 60)
    items = [(i, f"item number {i} is a sentence that is long enough {i}{i}{i}") for i in range(5)]
    df = spark.createDataFrame([(i, "see " + t, "x", 1) for i, t in items], DOCS)
    got = sorted((r.doc_id, r.item_id) for r in D.leaks(df, spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)).where("edits = 0").collect())
    assert got == [(i, i) for i in range(5)]


def test_banded_alignment_is_edit_distance():
    rng = np.random.default_rng(11)
    for _ in range(400):
        m, k = int(rng.integers(1, 14)), int(rng.integers(0, 5))
        item, region = rng.integers(0, 3, m).astype(np.uint32), rng.integers(0, 3, int(rng.integers(0, 25))).astype(np.uint32)
        got, e = D.distance(item, region, k), best(item.tolist(), region.tolist())
        assert (got is None) == (e > k)
        if got:
            assert got[0] == e and best(item.tolist(), region[got[1] : got[2]].tolist()) <= e and 0 <= got[1] <= got[2] <= len(region)


def test_one_repeated_letter_stays_small(monkeypatch):
    """A long text of one letter, an item of that letter: bounded memory, in chunks too."""
    items = D.Items([(1, "a" * 3000), (2, "ab" * 700)])
    for text in ("a" * 200_000 + "b" * 500 + "ab" * 5000, "x" * 1000 + "a" * 3100):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        tracemalloc.start()
        found = D.search(items, points, np.array([0, len(points)]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [(i, e) for _, i, e, _, _ in found] == ([(0, 0), (1, 0)] if text[0] == "a" else [(0, 0)])
        assert peak < 400 << 20
    monkeypatch.setattr(D, "CHUNK", 1000)
    assert [(i, e, s, t) for _, i, e, s, t in D.search(items, points, np.array([0, len(points)]))] == [(0, 0, 1000, 4000)]
