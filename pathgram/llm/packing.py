"""Packing documents into windows by best-fit decreasing.

Each task packs its own documents in rounds of bounded size, so nothing is shuffled and memory does
not grow with the input. A document longer than a window is first cut into full windows; its rest
and all shorter documents are pieces. Pieces go, longest first, into the open window with the least
room that still fits; a segment tree over the rooms finds it. Windows that stay open then give up
their pieces, least filled first, and the pieces are cut into the rooms left elsewhere. What stays
open is carried into the next round; the task's last window is cut into powers of two, as windows of
those lengths need no padding.

A null text counts as empty and is the end id alone. Rows that share an id are packed each on their
own; pieces of one row follow each other in the result. An empty table gives an empty result; other
columns are not read. Sequence numbers hold the task number in their upper bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathgram.llm.common import whole
from pathgram.llm.encoding import encoder

WINDOW = 4096
#: Ids of one packing round (four bytes each).
ROUND_IDS = 1 << 21
#: The last window of a task is cut into powers of two down to this length.
SMALLEST_TAIL = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, int]  # document number, first id, length


class Rooms:
    """A segment tree indexed by room: how many open windows have exactly that room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._step(room, 1)

    def _step(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least ``need``."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._step(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(pieces: list[Piece], window: int) -> list[list[Piece]]:
    """Windows of pieces; none is longer than ``window``."""
    rooms, out = Rooms(window), []
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        found = rooms.tightest(piece[2])
        room, at = found if found else (window, len(out))
        if not found:
            out.append([])
        out[at].append(piece)
        if room > piece[2]:
            rooms.add(room - piece[2], at)
    return out


def fill_up(windows: list[list[Piece]], window: int) -> list[list[Piece]]:
    """Cuts the pieces of the least filled windows into the rooms of the fuller ones; at most one stays open."""
    length = lambda w: sum(p[2] for p in w)
    full = [w for w in windows if length(w) == window]
    rest = sorted((w for w in windows if length(w) < window), key=length)
    low, high = 0, len(rest) - 1
    while low < high:
        room = window - length(rest[high])
        doc, start, size = rest[low].pop()
        rest[high].append((doc, start, min(size, room)))
        if size > room:
            rest[low].append((doc, start + room, size - room))
        if size >= room:
            high -= 1
        if not rest[low]:
            low += 1
    return full + [w for w in rest if w and length(w) == window] + [w for w in rest if w and length(w) < window]


def powers_of_two(pieces: list[Piece], smallest: int) -> list[list[Piece]]:
    """One window cut into windows whose lengths are powers of two; the last may be shorter than ``smallest``."""
    out, left, queue = [], sum(p[2] for p in pieces), list(pieces)
    while left:
        size = 1 << (left.bit_length() - 1) if left >= smallest else left
        part: list[Piece] = []
        need = size
        while need:
            doc, start, length = queue.pop(0)
            part.append((doc, start, min(length, need)))
            if length > need:
                queue.insert(0, (doc, start + need, length - need))
            need -= min(length, need)
        out.append(part)
        left -= size
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, round_ids: int = ROUND_IDS) -> DataFrame:
    """One row per piece, as in ``PIECES``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 33
        texts: dict[int, np.ndarray] = {}
        names: dict[int, int | None] = {}
        pieces: list[Piece] = []
        held, seen = 0, 0

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            cols: list[list] = [[] for _ in range(7)]
            for w in windows:
                offset = 0
                for doc, start, size in w:
                    crc = zlib.crc32(texts[doc][start : start + size].tobytes())
                    for col, v in zip(cols, (names[doc], start, size, crc, len(texts[doc]), number, offset), strict=True):
                        col.append(v)
                    offset += size
                number += 1
            fields = [f.split(" ")[0] for f in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=fields)

        def round_of(last: bool) -> pa.RecordBatch:
            """Packs what is held; keeps the open window's pieces unless it is the last round."""
            nonlocal pieces, held, texts, names
            whole_windows = [[p] for p in pieces if p[2] == window]
            windows = fill_up(best_fit_decreasing([p for p in pieces if p[2] < window], window), window)
            open_ = [w for w in windows if sum(p[2] for p in w) < window]
            out = rows(whole_windows + windows[: len(windows) - len(open_)] + (powers_of_two(open_[0], SMALLEST_TAIL) if last and open_ else []))
            pieces = [] if last else [p for w in open_ for p in w]
            need = {p[0] for p in pieces}
            texts, names = {d: texts[d] for d in need}, {d: names[d] for d in need}
            held = sum(len(t) for t in texts.values())
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = coder.ids(text.as_py(), end_id)
                texts[seen], names[seen] = ids, doc_id
                cut = range(0, len(ids), window)
                pieces += [(seen, a, min(window, len(ids) - a)) for a in cut]
                seen += 1
                held += len(ids)
                if held >= round_ids:
                    yield round_of(False)
        if pieces:
            yield round_of(True)

    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(packed, PIECES)
