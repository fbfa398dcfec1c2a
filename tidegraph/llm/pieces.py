"""SentencePiece encoding and decoding by a streaming Viterbi lattice.

The lattice has a node after every character; the edge into node i is the piece that
ends there.  For a BPE model the score of a path is its merge order, and of all paths to
a node exactly one is an encoding: the one whose neighbouring pieces are all stable, that
is, would not be merged otherwise if they stood alone.  So a piece may follow the
surviving path of its first node only if it is stable beside that path's last piece,
and each node keeps one backpointer.  Edges reach back no further than the longest
piece, so only the paths of that many last nodes can still go on; whenever they all run
through one boundary, the ids before it are committed and the lattice there is
dropped.  Memory is a window, whatever the length of the text.

Where no piece holds a space mark after another character, the start of a run of
spaces is a boundary of every path; runs between such boundaries are encoded once and
kept in a table of bounded size.  New runs are taken in order, and each goes on from the
nodes that it shares with the one before.

Decoding joins the pieces' bytes, byte pieces as their byte, and drops the first space.

Defined results: null and empty text have no ids and decode to empty text; characters
outside the vocabulary become their UTF-8 bytes; U+2581 is read as a space (the model's
own mark), so it decodes as one; repeated rows are encoded each; an empty table gives an
empty table; columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.llm import _text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Size of a model file that may be sent to executors.
MAX_MODEL_BYTES = 64 << 20
CACHE = 400_000
MARK = "▁"
_NEVER = float("inf")


class Vocabulary:
    """Pieces, ranks and bytes of a BPE model with byte fallback."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read(MAX_MODEL_BYTES + 1)
        if len(raw) > MAX_MODEL_BYTES:
            raise ValueError(f"{path} has more than {MAX_MODEL_BYTES} bytes")
        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.id: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes: list[bytes] = []
        self.byte_id = [model.unk_id()] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.id[piece] = i
                self.rank[piece] = -model.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.id))
        self.starts = {p[:n] for p in self.id for n in range(1, len(p))}
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.id)


class Lattice:
    """The lattice of one stream of characters; ``feed`` and ``finish`` yield committed ids."""

    def __init__(self, vocabulary: Vocabulary, stable: dict | None = None):
        self.v = vocabulary
        self.stable = {} if stable is None else stable
        self.grown: dict[str, tuple[list, list] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.text = ""  # characters since the last commit
        self.last: list[str | None] = [None]  # surviving piece into each node
        self.left: str | None = None  # committed piece before the first node

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """How the ends of ``piece`` grow as it is merged: ``(symbol, rank of the next growth)``
        of its left and of its right end, or None if merging does not give the piece back."""
        known = self.grown.get(piece, 0)
        if known != 0:
            return known
        parts, rank, left, right = list(piece), self.v.rank, [], []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out = ([*left, (piece, _NEVER)], [*right, (piece, _NEVER)]) if len(parts) == 1 else None
        if len(self.grown) > CACHE:
            self.grown.clear()
        self.grown[piece] = out
        return out

    def _stable(self, a: str | None, b: str) -> bool:
        """Whether ``a`` and ``b``, side by side, are merged apart: no pair of ends they have on the way is merged first."""
        own = self._edges(b)
        if own is None:
            return False
        if a is None:
            return True
        left, right, rank, i, j = self._edges(a)[1], own[0], self.v.rank, 0, 0
        while True:
            (x, grows_x), (y, grows_y) = left[i], right[j]
            r = rank.get(x + y)
            if r is not None and r < grows_x and r <= grows_y:
                return False
            if grows_x == grows_y == _NEVER:
                return True
            if grows_x <= grows_y:
                i += 1
            else:
                j += 1

    def _follows(self, a: str | None, b: str) -> bool:
        key = (a, b)
        known = self.stable.get(key)
        if known is None:
            known = self._stable(a, b)
            if len(self.stable) > CACHE:
                self.stable.clear()
            self.stable[key] = known
        return known

    def _step(self) -> None:
        """Find the survivor of the node after the last character."""
        text, last, n = self.text, self.last, len(self.text)
        for j in range(max(0, n - self.v.longest), n):
            piece = text[j:n]
            if (n - j == 1 or piece in self.v.rank) and self._follows(last[j] if j else self.left, piece):
                last.append(piece)
                return
        raise AssertionError("no path reaches a node")

    def _converged(self) -> int:
        """The last boundary that the paths of all live nodes share."""
        live = set(range(max(0, len(self.text) - self.v.longest + 1), len(self.text) + 1))
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(far - len(self.last[far] or ""))
        return live.pop()

    def _commit(self, node: int) -> list[int]:
        pieces, at = [], node
        while at > 0:
            pieces.append(self.last[at])
            at -= len(self.last[at])
        pieces.reverse()
        if pieces:
            self.left = pieces[-1]
            self.text, self.last = self.text[node:], [None, *self.last[node + 1 :]]
        return [i for p in pieces for i in self.ids_of(p)]

    def ids_of(self, piece: str) -> list[int]:
        own = self.v.id.get(piece)
        return [own] if own is not None else [self.v.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]

    def feed(self, text: str) -> Iterator[int]:
        for c in text:
            self.text += c
            self._step()
            if len(self.text) >= 4 * self.v.longest:
                yield from self._commit(self._converged())

    def finish(self) -> list[int]:
        out = self._commit(len(self.text))
        self._reset()
        return out


class Encoder:
    """Encodes many texts at once; runs of spaces and characters are looked up or sent through a lattice."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[int, tuple[int, ...]] = {}
        self.older: dict[int, tuple[int, ...]] = {}
        self.lattice = Lattice(vocabulary)
        # Of each beginning of a piece: its ids if it is a piece itself, and whether it goes on to others.
        self.kind: dict[str, tuple[tuple[int, ...] | None, bool]] = dict.fromkeys(vocabulary.starts, (None, True))
        self.kind |= {p: ((i,), p in vocabulary.starts) for p, i in vocabulary.id.items()}
        self.piece_at = np.concatenate([[0], np.cumsum([len(b) for b in vocabulary.bytes])])
        self.piece_bytes = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)

    def run_ids(self, runs: list[str]) -> list[tuple[int, ...]]:
        """Ids of each run; best in sorted order, as a run keeps the nodes of the beginning it shares with the one before."""
        out, before = [], ""
        # Of each node: the surviving piece into it, the ids up to it, and the earlier nodes from which pieces may go on.
        last: list[str | None] = [None]
        ids: list[tuple[int, ...]] = [()]
        live: list[list[int]] = [[]]
        kind, stable, follows, ids_of = self.kind, self.lattice.stable, self.lattice._follows, self.lattice.ids_of
        for run in runs:
            if len(run) > 64:
                head = list(self.lattice.feed(run))
                out.append((*head, *self.lattice.finish()))
                continue
            # A run that fits the window: the same steps without the bookkeeping of commits.
            n, size = 0, min(len(run), len(before))
            while n < size and run[n] == before[n]:
                n += 1
            del last[n + 1 :], ids[n + 1 :], live[n + 1 :]
            before = run
            for n in range(n + 1, len(run) + 1):
                survivor, on = None, []
                for j in (*live[-1], n - 1):
                    piece = run[j:n]
                    known = kind.get(piece)
                    if known is None:
                        if j < n - 1:
                            continue
                        known = tuple(ids_of(piece)), False
                    own, more = known
                    if more:
                        on.append(j)
                        if own is None and j == n - 1:
                            own = tuple(ids_of(piece))
                    if survivor is None and own is not None:
                        key = (last[j], piece)
                        if stable[key] if key in stable else follows(*key):
                            survivor = piece
                            ids.append(ids[j] + own)
                if survivor is None:
                    raise AssertionError("no path reaches a node")
                last.append(survivor)
                live.append(on)
            out.append(ids[-1])
        return out

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the rows' offsets in them."""
        full = np.flatnonzero(np.diff(at))
        spaced = np.insert(data, at[full], 32)
        to = at + np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
        if not len(spaced):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        if self.v.splits:
            space = self._space(spaced)
            head = space.copy()
            head[1:] &= ~space[:-1]
            head[to[full]] = True
            starts = np.flatnonzero(head)
        else:
            starts = to[full]
        ends = np.append(starts[1:], len(spaced))
        hashes = _text.word_hashes(spaced, starts, ends)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw, found = spaced.tobytes(), []
        if not _same(spaced, starts, ends, first[inverse]):  # two runs of one hash: tell them apart by their bytes
            seen: dict[bytes, int] = {}
            inverse = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            first = np.unique(inverse, return_index=True)[1]
        new: list[tuple[bytes, int]] = []
        for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            h = raw[a:b]
            ids = self.known.get(h)
            if ids is None:
                ids = self.older.get(h)
                if ids is None:
                    new.append((h, len(found)))
                else:
                    self._keep(h, ids)
            found.append(ids)
        new.sort()
        for (h, i), ids in zip(new, self.run_ids([h.decode("utf-8", "replace").replace(" ", MARK) for h, _ in new]), strict=True):
            found[i] = ids
            self._keep(h, ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        begin = np.cumsum(size) - size
        count = size[inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        out = flat[np.arange(total[-1]) - np.repeat(total[:-1] - begin[inverse], count)]
        return out, total[np.searchsorted(starts, to)]

    def _keep(self, run: bytes, ids: tuple[int, ...]) -> None:
        if len(run) <= 64:
            if len(self.known) >= CACHE:
                self.older, self.known = self.known, {}
            self.known[run] = ids

    @staticmethod
    def _space(data: np.ndarray) -> np.ndarray:
        """True on spaces and on the first byte of the mark U+2581 (its other bytes count as spaces too)."""
        space = data == 32
        if len(data) > 2:
            mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            for k in range(3):
                space[mark + k] = True
        return space

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows and their offsets, without the first space of a row."""
        size = self.piece_at[ids + 1] - self.piece_at[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.piece_bytes[np.arange(total[-1]) - np.repeat(total[:-1] - self.piece_at[ids], size)]
        to = total[at]
        full = np.flatnonzero(np.diff(to))
        lead = to[full][out[to[full]] == 32]
        return np.delete(out, lead), to - np.searchsorted(lead, to)


def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether every run has the bytes of the run that stands for it."""
    size = ends - starts
    if (size != size[like]).any():
        return False
    for a in range(0, len(size), 1 << 16):
        own = size[a : a + (1 << 16)]
        begin = np.cumsum(own) - own
        place = np.arange(int(own.sum()), dtype=np.int64)
        if (data[place + np.repeat(starts[a : a + (1 << 16)] - begin, own)] != data[place + np.repeat(starts[like[a : a + (1 << 16)]] - begin, own)]).any():
            return False
    return True


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, shared) -> Encoder:
    """The encoder of this worker process: its table of runs serves task after task."""
    if path not in _encoders:
        _encoders[path] = Encoder(shared.value)
    return _encoders[path]


def _each(df: DataFrame, make, schema: str, path: str) -> DataFrame:
    scratch.ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared)
        for batch in batches:
            for part in make(encoder, batch):
                yield part

    return df.mapInArrow(run, schema)


def _encoded(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in _text.slices(batch, limit=1 << 21):
        data, at = _text.text_bytes(part.column(1))
        ids, to = encoder.encode(data, at)
        back, where = encoder.decode(ids, to)
        same = np.diff(where) == np.diff(at)
        if same.all():
            rows = np.flatnonzero(back != data) if len(back) == len(data) else np.arange(0)
            same[np.searchsorted(at, rows, "right") - 1] = False
        else:
            same = np.array([back[where[i] : where[i + 1]].tobytes() == data[at[i] : at[i + 1]].tobytes() for i in range(len(same))])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(to)), _text.list_array(ids, to), pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)``; round_trip: decoding the ids gave the text again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _each(rows, _encoded, "doc_id long, n_tokens long, ids array<int>, round_trip boolean", path)


def _decoded(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids = batch.column(1)
    if ids.null_count:
        ids = pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int32()))
    at = np.asarray(ids.offsets).astype(np.int64)
    flat = np.asarray(ids.values)[at[0] : at[-1]].astype(np.int64)
    data, to = encoder.decode(flat, at - at[0])
    text = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids are empty text."""
    return _each(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), _decoded, "doc_id long, text string", path)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
