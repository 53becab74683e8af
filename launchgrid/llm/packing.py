"""Packing documents into windows of a fixed number of tokens.

Sum-of-squares online packing: whole windows of a long document are cut off first; the
rest goes where it leaves the least sum over fill levels of the squared count of open
windows: onto an open window of some level, or into a new one. The counts by level are one
array. A level is a range of fills, 1/LEVELS of a window, so a piece fits a window exactly if
it overhangs by less than a level: the overhang is cut off and placed like any other piece. So
few windows are open at any time, and placement fills nearly all of them. Each partition
packs its own rows, in one pass, keeping only its open windows.

At a partition's end the emptiest of the windows still open, some LEVELS of them, are cut to
fill the others, and what is left over (less than a window) is cut into runs whose lengths
are powers of two, which need no padding. So a partition pads nothing. ``placed`` tells the
pieces that lie where placement put them from those that the end moved.

Order within a partition decides the packing: give it a scan or a written table, whose
order is the same when a lost task runs again.

Defined results: a null or empty text is the single end id; a repeated row is packed
again; columns other than id and text are never read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchgrid.llm.storage import bounded_batches

WINDOW = 1024
LEVELS = 16
END_ID = 0
FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def load_tokenizer(path: str, added_tokens: bool = False):
    """A fast encoder (text to ids) with the vocabulary and byte alphabet of a ``tokenizers`` JSON file.

    The file is a byte-level BPE whose ids are in the order of its merges, so its ids are
    merge ranks; the tests hold the ids against the ``tokenizers`` library. The strings of the
    file's added tokens are ordinary text, as with ``encode_special_tokens = True``, the
    loading that the file's own description gives; with ``added_tokens`` they are those tokens.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    coder = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special) if added_tokens else set()
    return lambda text: coder.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


class SumOfSquares:
    """Open windows by fill level, and where the next run of ids goes.

    A piece is (document, start, ids, the document's ids in all); a row of ``done`` is a piece's
    (document, start, length, crc32, ids in all, sequence, offset, placed).
    """

    def __init__(self, window: int, first_id: int, levels: int = LEVELS):
        self.window, self.next_id = window, first_id
        self.levels = min(levels, window)
        self.overhang = window // self.levels - 1
        self.count = np.zeros(self.levels, np.int64)
        self.open: list[list[list]] = [[] for _ in range(self.levels)]  # of each level, its windows: [fill, pieces]
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple], placed: bool = True) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at, placed))
            at += len(ids)
        self.next_id += 1

    def add(self, doc: object, ids: np.ndarray) -> None:
        w, total = self.window, len(ids)
        cut = total - total % w
        for at in range(0, cut, w):
            self._emit([(doc, at, ids[at : at + w], total)])
        rest = (doc, cut, ids[cut:], total) if cut < total else None
        while rest:
            rest = self._place(rest)

    def _place(self, piece: tuple) -> tuple | None:
        """Put a piece where it costs least, the fuller window in a tie; returns what overhangs."""
        w, n, size = self.window, self.count, len(piece[2])
        level_of = lambda fill: fill * self.levels // w
        from_, best = None, 2 * n[level_of(size)] + 1  # a new window
        for level, windows in enumerate(self.open):
            if windows:
                fill = windows[-1][0] + size
                if fill > w + self.overhang:
                    break
                to = level_of(fill)
                cost = 1 - 2 * n[level] if fill >= w else 0 if to == level else 2 - 2 * n[level] + 2 * n[to]
                if cost <= best:
                    from_, best = level, cost
        fill, pieces = (0, []) if from_ is None else self.open[from_].pop()
        if from_ is not None:
            n[from_] -= 1
        doc, start, ids, total = piece
        room = w - fill
        pieces.append((doc, start, ids[:room], total))
        if fill + size < w:
            self.open[level_of(fill + size)].append([fill + size, pieces])
            n[level_of(fill + size)] += 1
            return None
        self._emit(pieces)
        return (doc, start + room, ids[room:], total) if size > room else None

    def close(self) -> None:
        """Fill the fuller open windows from the emptiest ones; the last one becomes powers of two."""
        left = sorted((x for windows in self.open for x in windows), key=lambda x: x[0])
        self.open = [[] for _ in range(self.levels)]
        self.count[:] = 0
        while len(left) > 1:
            fill, pieces = left.pop()
            while fill < self.window and left:
                doc, start, ids, total = left[0][1].pop()
                part = min(self.window - fill, len(ids))
                keep = len(ids) - part
                pieces.append((doc, start + keep, ids[keep:], total))
                if keep:
                    left[0][1].append((doc, start, ids[:keep], total))
                fill += part
                left[0][0] -= part
                if not left[0][0]:
                    left.pop(0)
            if fill < self.window:
                left.append([fill, pieces])
                break
            self._emit(pieces, False)
        rest = sum(fill for fill, _ in left)
        room, run = 0, []
        for doc, start, ids, total in (p for _, pieces in left for p in pieces):
            while len(ids):
                room = room or 1 << rest.bit_length() - 1
                part = ids[:room]
                run.append((doc, start, part, total))
                ids, start, room, rest = ids[room:], start + len(part), room - len(part), rest - len(part)
                if not room:
                    self._emit(run, False)
                    run = []

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, placed."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType
    out = T.StructType([T.StructField(id_col, kind), *(T.StructField(f, T.LongType()) for f in FIELDS), T.StructField("placed", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(path, added_tokens)
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 33)
        schema = None
        for batch in batches:
            schema = schema or pa.schema([(id_col, batch.schema.field("id").type), *((f, pa.int64()) for f in FIELDS), ("placed", pa.bool_())])
            for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
                text = text.as_py()
                ids = np.append(encode(text), end_id) if text else np.array([end_id])
                packer.add(doc.as_py(), ids.astype("<u4"))
            yield rows(packer.take(), schema)
        packer.close()
        if schema is not None:
            yield rows(packer.take(), schema)

    def rows(pieces: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*pieces, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return plain.mapInArrow(run, out)
