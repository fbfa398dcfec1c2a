"""Chat formatting: a hidden Markov model recovers who speaks in raw transcripts.

A transcript is lines in order.  Each line is in one of six states, a role (system, user,
assistant) and whether it begins a turn.  What is seen of a line is its speaker marker
(``User:``, ``### Assistant``, ``<|system|>``, ``[Human]``, ...), if any, and simple features:
blank line before, question mark.  Viterbi gives the best states; turns are cut where one
begins, the marker that begins it is taken off, and each turn is rendered canonically.  The
other lines stay as they are, blank ones too, but for blank lines at the ends of a turn.

Long transcripts are taken in blocks of at most ``BLOCK`` input rows and ``BLOCK_BYTES`` bytes (one row at least), cut from the
sorted rows, so no task holds a whole one.  A block is summed up by the best score between any state before it and its
last, with and without a blank line before it (2 x 42 numbers); the blocks' matrices, chained per transcript,
give each block the scores before and after it, with which it is decoded exactly as in one piece: scores are whole
numbers, and a small number drawn by each line's place decides between paths of equal probability.  Where a turn
goes on in the next blocks, its pieces are joined again: the result is the same for every size of blocks.

Defined results: null texts are empty; equal rows of a conversation are one turn; rows with a null
``conv_id`` or ``turn`` are transcripts of their own; rows of one turn are in the order of
their text; an empty table gives an empty table; ``role`` is not read by the parser; other
columns are not read, whatever they are called.  One very long row is a block by itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch

ROLES = ["system", "user", "assistant"]
BLOCK = 64
BLOCK_BYTES = 1 << 18
#: Words that name a speaker, by role.  Fixed values.
SPEAKERS = {"system": "system|instructions?|context", "user": "user|human|customer|q|question|me", "assistant": "assistant|ai|bot|model|agent|a|answer"}
_MARK = re.compile(
    r"^\s*(?:#{1,4}\s*|\*\*|<\|(?:im_start\|>)?|\[|>\s*)?(?:(?P<system>" + SPEAKERS["system"] + r")|(?P<user>" + SPEAKERS["user"] + r")|(?P<assistant>" + SPEAKERS["assistant"] + r"))"
    r"(?:(?:\*\*)?\s*:(?:\*\*)?|\|>|\]:?|\s*$)\s*",
    re.IGNORECASE,
)
_N = 6  # state 2 * role + (1 if the line continues a turn)


#: Scores are log probabilities times 2 ** 36; the lower 16 bits decide between equal ones.
_UNIT, _DRAW = 1 << 20, 16
_NEVER, _NOWHERE = -1e6, -(1 << 61)


def _log(p: float) -> float:
    return float(np.log(p))


def _whole(logs) -> np.ndarray:
    return np.rint(np.asarray(logs) * _UNIT).astype(np.int64) << _DRAW


def _transitions() -> np.ndarray:
    """log p(next state | state)."""
    follow = np.array([[0.02, 0.88, 0.10], [0.02, 0.06, 0.92], [0.03, 0.91, 0.06]])
    out = np.full((_N, _N), _NEVER)
    for r in range(3):
        for c in range(2):
            out[2 * r + c, 2 * r + 1] = _log(0.55)
            for q in range(3):
                out[2 * r + c, 2 * q] = _log(0.45 * follow[r, q])
    return _whole(out)


TRANSITIONS = _transitions()
START = _whole([_log(0.3), _NEVER, _log(0.62), _NEVER, _log(0.08), _NEVER])


def marker(line: str) -> tuple[int, str]:
    """Role number of the line's speaker marker (-1: none) and the line without it."""
    m = _MARK.match(line)
    if not m:
        return -1, line
    return ROLES.index(m.lastgroup), line[m.end() :]


def emission(line: str, role: int, gap: bool) -> np.ndarray:
    """log p(what is seen of the line | state)."""
    out = np.empty(_N)
    asks = line.rstrip().endswith("?")
    for r in range(3):
        begin = _log(0.86) if role == r else _log(0.12) if role < 0 else _log(0.01)
        more = _log(0.985) if role < 0 else _log(0.005)
        # A blank line comes before most turns and few other lines.
        begin += _log(0.9) if gap else _log(0.1)
        more += _log(0.1) if gap else _log(0.9)
        question = 0.35 if r == 1 else 0.05
        ask = _log(question) if asks else _log(1 - question)
        out[2 * r], out[2 * r + 1] = begin + ask, more + ask
    return out


def _draws(where: tuple[int, int, int]) -> np.ndarray:
    """Six small numbers that a line's place gives."""
    seed = zlib.crc32(b"%d,%d,%d" % where)
    return (seed * np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x2545F491]) >> 15) & ((1 << _DRAW) - 1)


def _observe(lines: list[str], gap: bool, where: list[tuple[int, int, int]] | None = None) -> tuple[np.ndarray, list[str], list[int], bool]:
    """Emissions of the lines that are not blank, their text without a marker, their places, and whether a blank
    line comes after the last; ``gap``: whether one comes before the first."""
    seen, texts, places = [], [], []
    for i, line in enumerate(lines):
        if not line.strip():
            gap = True
            continue
        role, rest = marker(line)
        seen.append(_whole(emission(rest, role, gap)) + _draws(where[i] if where else (0, i, 0)))
        texts.append(rest)
        places.append(i)
        gap = False
    return (np.array(seen) if seen else np.zeros((0, _N), np.int64)), texts, places, gap


def summed(seen: np.ndarray) -> np.ndarray:
    """Best scores from before the block to the state of its last line (max-plus product).

    A row for each state before the block, and a last one for a block that opens the transcript.
    """
    if not len(seen):
        return np.vstack([np.where(np.eye(_N, dtype=bool), 0, _NOWHERE), START])
    total = np.vstack([TRANSITIONS, START]) + seen[0]
    for e in seen[1:]:
        total = (total[:, :, None] + TRANSITIONS[None]).max(axis=1) + e
    return total


def decode(seen: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> np.ndarray:
    """Best states of a block; ``before`` has the scores of the state before it (None: the start)."""
    n = len(seen)
    if not n:
        return np.zeros(0, np.int64)
    came = np.zeros((n, _N), np.int64)
    if before is None:
        best = START + seen[0]
    else:
        step = before[:, None] + TRANSITIONS
        came[0], best = step.argmax(axis=0), step.max(axis=0) + seen[0]
    for t in range(1, n):
        step = best[:, None] + TRANSITIONS
        came[t], best = step.argmax(axis=0), step.max(axis=0) + seen[t]
    out = np.empty(n, np.int64)
    out[-1] = (best + after).argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = came[t, out[t]]
    return out


def canonical(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


_ITEMS = "array<struct<turn: long, raw: string>>"


def _cut(size: int, most: int):
    """Sorted rows of ``(conv, turn, raw)`` as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("turn", pa.int64()), ("raw", pa.string())]))
        conv, items, held = None, [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([items], kind)], ["conv", "items"])

        for batch in batches:
            for c, turn, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if items and (c != conv or len(items) >= size or held + len(raw or "") > most):
                    yield block()
                    items, held = [], 0
                conv = c
                items.append({"turn": turn, "raw": raw})
                held += len(raw or "")
        if items:
            yield block()

    return run


def blocks_of(raw: DataFrame, size: int = BLOCK, most: int = BLOCK_BYTES) -> DataFrame:
    """``(conv, block, items)`` from ``(conv, turn, raw)``: at most ``size`` rows and ``most`` bytes a block; ``block`` rises in order."""
    rows = raw.select("conv", "turn", "raw").distinct()
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "conv", "turn", F.substring("raw", 1, 64)).sortWithinPartitions("conv", "turn", "raw")
    return dealt.mapInArrow(_cut(size, most), f"conv string, items {_ITEMS}").select("conv", F.monotonically_increasing_id().alias("block"), "items")


def _lines(items) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Lines, and of each the turn, the place in its row, and the row's checksum."""
    lines, where = [], []
    for x in items:
        check = zlib.crc32((x["raw"] or "").encode())
        for i, line in enumerate((x["raw"] or "").split("\n")):
            lines.append(line)
            where.append((x["turn"], i, check))
    return lines, where


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, gaps = [], []
        for items in batch.column(2).to_pylist():
            lines, where = _lines(items)
            each = [_observe(lines, gap, where) for gap in (False, True)]
            out.append(np.concatenate([summed(x[0]).ravel() for x in each]).tolist())
            gaps.append(each[0][3])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(gaps, pa.bool_())], ["conv", "block", "m", "gap"])


def _level(x: np.ndarray) -> np.ndarray:
    """Scores relative to the best: only differences count."""
    return x - x.max()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores before and after each block of a transcript, and whether a blank line (or nothing) comes before it, from its blocks' matrices in order."""
    for batch in batches:
        conv, block, before, after, blank = [], [], [], [], []
        for key, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            gaps = [True, *(x["gap"] for x in items)]
            ms = [np.array(x["m"], np.int64).reshape(2, _N + 1, _N)[int(gap)] for x, gap in zip(items, gaps[:-1], strict=True)]
            # A block of blank lines changes no score; one that opens the transcript leaves it to open.
            empty = [bool((np.diag(m[:_N]) == 0).all()) and m[0, 1] == _NOWHERE for m in ms]
            ahead = [None]
            for m, none in zip(ms[:-1], empty[:-1], strict=True):
                last = ahead[-1]
                ahead.append(last if none else _level(m[_N] if last is None else (last[:, None] + m[:_N]).max(axis=0)))
            back = [np.zeros(_N, np.int64)]
            for m, none in zip(ms[:0:-1], empty[:0:-1], strict=True):
                back.append(back[-1] if none else _level((m[:_N] + back[-1][None]).max(axis=1)))
            for x, a, b, gap in zip(items, ahead, back[::-1], gaps[:-1], strict=True):
                conv.append(key)
                block.append(x["block"])
                before.append(None if a is None else a.tolist())
                after.append(b.tolist())
                blank.append(gap)
        kind = pa.list_(pa.int64())
        columns = [pa.array(conv, pa.string()), pa.array(block, pa.int64()), pa.array(before, kind), pa.array(after, kind), pa.array(blank, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "block", "before", "after", "blank"])


def _joined(lines: list[str]) -> str:
    """The lines without the blank ones at both ends."""
    full = [i for i, line in enumerate(lines) if line.strip()]
    return "\n".join(lines[full[0] : full[-1] + 1]) if full else ""


_TURN = "conv string, turn long, line long, role string, text string, rendered string"
_PIECE = "conv string, block long, head boolean, tail boolean, turn long, line long, role string, lines string"


def _decoded(items, before, after, blank) -> list[tuple[bool, int, int, str, list[str]]]:
    """``(begins, turn, line, role, lines)`` of the pieces of a block; the first may go on with the turn of the block before."""
    lines, where = _lines(items)
    seen, texts, places, _ = _observe(lines, True if blank is None else blank, where)
    states = decode(seen, None if before is None else np.array(before, np.int64), np.array(after or [0] * _N, np.int64))
    cut = [i for i in range(len(states)) if states[i] % 2 == 0]
    ends = [places[i] for i in cut] + [len(lines)]
    out = []
    if not cut or cut[0] > 0:
        out.append((False, 0, 0, "", lines[: ends[0]]))
    for k, i in enumerate(cut):
        out.append((True, *where[places[i]][:2], ROLES[states[i] // 2], [texts[i], *lines[places[i] + 1 : ends[k + 1]]]))
    return out


def _decode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of transcripts of one block."""
    for batch in batches:
        rows = [
            (conv, turn, line, role, _joined(lines), canonical(role, _joined(lines)))
            for conv, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for begins, turn, line, role, lines in _decoded(items, None, None, None)
            if begins
        ]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        data = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(data, kinds, strict=True)], ["conv", "turn", "line", "role", "text", "rendered"])


def _decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the blocks of long transcripts: ``head`` goes on with a turn, ``tail`` may go on in the next block."""
    for batch in batches:
        rows = []
        for conv, block, *block_of in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            pieces = _decoded(*block_of)
            for k, (begins, turn, line, role, lines) in enumerate(pieces):
                rows.append((conv, block, not begins, begins and k == len(pieces) - 1, turn, line, role, "\n".join(lines)))
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        data = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(data, kinds, strict=True)], ["conv", "block", "head", "tail", "turn", "line", "role", "lines"])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        role, pieces = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        text = [_joined("\n".join(p).split("\n")) for p in pieces]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(text, pa.string()), pa.array([canonical(r, t) for r, t in zip(role, text, strict=True)], pa.string())], ["conv", "turn", "line", "role", "text", "rendered"])


def _owners(pieces: DataFrame) -> DataFrame:
    """``(conv, block, owner)``: for blocks that begin inside a turn, the block where it begins.  Two numbers a block, no text."""
    marks = pieces.where("head OR tail").groupBy("conv", "block").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    each = marks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "head", "tail"))).alias("marks"))
    kind = "struct<last: long, out: array<struct<block: long, owner: long>>>"
    walked = F.aggregate(
        "marks",
        F.expr(f"CAST(struct(NULL, array()) AS {kind})"),
        lambda a, x: F.struct(
            F.when(x["tail"], x["block"]).otherwise(a["last"]).alias("last"),
            F.when(x["head"], F.concat(a["out"], F.array(F.struct(x["block"].alias("block"), a["last"].alias("owner"))))).otherwise(a["out"]).alias("out"),
        ).cast(kind),
    )
    return each.select("conv", F.explode(walked["out"]).alias("o")).select("conv", "o.block", "o.owner").where("owner IS NOT NULL")


def recover(raw: DataFrame, size: int = BLOCK, most: int = BLOCK_BYTES) -> DataFrame:
    """``(conv, turn, line, role, text, rendered)``: the recovered turns of ``(conv, turn, raw)``.

    ``turn`` and ``line`` tell the input row and the line in it where a turn begins.
    """
    scratch.ship_package(raw.sparkSession)
    blocks = scratch.materialize(blocks_of(raw, size, most), "blocks")
    long = scratch.materialize(blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv"), "long")
    short = blocks.join(long, "conv", "left_anti").select("conv", "items").mapInArrow(_decode_whole, _TURN)
    several = scratch.materialize(blocks.join(long, "conv", "left_semi").select("conv", "block", "items"), "several")
    # 84 numbers for each block of a transcript that has several.
    sums = several.mapInArrow(_sum_blocks, "conv string, block long, m array<long>, gap boolean")
    chains = sums.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "m", "gap"))).alias("items"))
    ends = scratch.materialize(chains.mapInArrow(_chain, "conv string, block long, before array<long>, after array<long>, blank boolean"), "ends")
    both = several.join(ends, ["conv", "block"]).select("conv", "block", "items", "before", "after", "blank")
    pieces = scratch.materialize(both.mapInArrow(_decode_blocks, _PIECE), "pieces")
    owners = _owners(pieces)
    heads = pieces.where("head").join(owners, ["conv", "block"]).select("conv", F.col("owner").alias("at"), "block", "head", "turn", "line", "role", "lines")
    tails = pieces.where("tail").select("conv", F.col("block").alias("at"), "block", "head", "turn", "line", "role", "lines")
    first = F.min(F.struct("head", "block", "turn", "line", "role"))
    joined = heads.unionByName(tails).groupBy("conv", "at").agg(first.alias("f"), F.sort_array(F.collect_list(F.struct("block", "lines")))["lines"].alias("pieces"))
    inner = pieces.where("NOT head AND NOT tail").select("conv", "turn", "line", "role", F.array("lines").alias("pieces"))
    turns = joined.select("conv", "f.turn", "f.line", "f.role", "pieces").unionByName(inner)
    return short.unionByName(turns.mapInArrow(_render, _TURN))


def raw_turns(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, raw)``: stored turns as people paste them - a style a conversation, some markers missing."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    names: dict[str, list[str]] = {"system": ["System: ", "### System:\n", "[system] ", "<|system|>\n"], "user": ["User: ", "### Human:\n", "[user] ", "<|user|>\n"], "assistant": ["Assistant: ", "### Assistant:\n", "[assistant] ", "<|assistant|>\n"]}

    def mark(role: str) -> Column:
        out = F.lit("")
        for i, m in enumerate(names[role]):
            out = F.when(style == i, m).otherwise(out)
        return out

    missing = (F.pmod(F.xxhash64("conv_id", "turn", F.lit("mark")), F.lit(12)) == 0) & (F.col("turn") > 0)
    head = F.when(missing | F.col("role").isNull(), "\n").otherwise(F.coalesce(*[F.when(F.col("role") == r, mark(r)) for r in ROLES], F.lit("\n")))
    own = F.col("conv_id").isNull() | F.col("turn").isNull()
    alone = F.concat(F.lit("row "), F.xxhash64("conv_id", "turn", "role", "text").cast("string"))
    return conversations.select(
        F.when(own, alone).otherwise(F.col("conv_id").cast("string")).alias("conv"),
        F.when(own, 0).otherwise(F.col("turn")).cast("long").alias("turn"),
        F.concat(head, F.coalesce("text", F.lit(""))).alias("raw"),
    )


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return recover(raw_turns(rows)).select(F.col("conv").try_cast("long").alias("conv_id"), "turn", "line", "role", "rendered")
