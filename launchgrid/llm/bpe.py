"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged separately. A segment tree over its byte
positions holds, at each leaf, the rank of the pair that starts there joined with the
position, so the root is the leftmost pair of least rank. A merge writes three leaves
(the merged symbol, the swallowed one, the live neighbour before) and their ancestors:
logarithmic work. Short matches, nearly all, run through many trees of one size at a
time in numpy; longer ones use one tree each.

A worker numbers the distinct matches it meets and keeps their ids in one flat array, so a
text's ids are one gather; decoding is a gather of token bytes by id. Texts are encoded some
megabytes at a time, and decoded some ids at a time.

Defined results: a null text encodes as the empty text, to an empty list; null ids decode
to empty bytes; an id outside the file raises; other columns of the input are never read,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchgrid.llm.storage import bounded_batches
from launchgrid.llm.textkit import slices

NONE = np.int32(2**31 - 1)
SHORT = 64  # bytes of a match that shares its trees' arrays with others
TREES = 20_000  # of short matches, advanced together
MOST_PIECES, MOST_BYTES = 400_000, 1 << 26  # distinct matches that a worker keeps
PART = 1 << 18  # ids decoded at a time


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


def taken(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat`` (run i begins at starts[i]) laid end to end, and their sizes."""
    begin = starts[which]
    size = starts[which + 1] - begin
    end = np.cumsum(size)
    return flat[np.repeat(begin - end + size, size) + np.arange(end[-1] if len(end) else 0)], size


def runs(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as one array and where each begins, one more than there are."""
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([0, *map(len, values)])


class _PairRanks:
    """Rank of the token that two neighbouring symbols make, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.of = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    self.of[a << 20 | b] = r
        bits = max(4, (4 * len(self.of)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys, values = np.fromiter(self.of, np.int64, len(self.of)), np.fromiter(self.of.values(), np.int32, len(self.of))
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of keys that want one slot, the last stays
            own = self.keys[at] == keys
            self.ranks[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NONE where the pair makes no token."""
        key = a.astype(np.int64) << 20 | b
        at = self._slot(key)
        seen = self.keys[at]
        away = np.flatnonzero((seen != key) & (seen >= 0))
        while len(away):
            at[away] = (at[away] + 1) & self.mask
            seen = self.keys[at[away]]
            away = away[(seen != key[away]) & (seen >= 0)]
        return self.ranks[at]


class SegmentTreeBpe:
    """Merges by rank for many byte strings at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pair = _PairRanks(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        two = np.arange(1 << 16)
        self.byte_pair = self.pair(self.byte_id[two >> 8], self.byte_id[two & 255])

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and how many each has."""
        n = len(pieces)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, n)
        size = np.fromiter(map(len, pieces), np.int64, n)
        open_ = (whole < 0) & (size > 0)
        count = (whole >= 0).astype(np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        for i in np.flatnonzero(open_ & (size > SHORT)).tolist():
            ids = np.array(self._long(pieces[i]), np.int32)
            count[i] = len(ids)
            parts.append((np.array([i]), ids))
        width = 2
        while width <= SHORT:
            members = np.flatnonzero(open_ & (size > width // 2) & (size <= width))
            for at in range(0, len(members), TREES):
                own = members[at : at + TREES]
                ids, count[own] = self._short([pieces[i] for i in own], size[own], width)
                parts.append((own, ids))
            width *= 2
        starts = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(starts[-1], np.int32)
        for own, ids in parts:
            c = count[own]
            out[np.repeat(starts[own] - np.cumsum(c) + c, c) + np.arange(len(ids))] = ids
        return out, count

    def _short(self, pieces: list[bytes], length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """One tree of ``size`` leaves for each piece, all advanced together."""
        n = len(pieces)
        where = np.arange(size)
        live = where < length[:, None]
        raw = np.zeros((n, size), np.int64)
        raw[live] = np.frombuffer(b"".join(pieces), np.uint8)
        sym = np.where(live, self.byte_id[raw], -1).astype(np.int32)
        after = np.where(where + 1 < length[:, None], where + 1, -1).astype(np.int32)
        before = np.broadcast_to(where - 1, (n, size)).astype(np.int32)
        tree = np.full((n, 2 * size), NONE, np.int32)
        rank = self.byte_pair[raw[:, :-1] << 8 | raw[:, 1:]]
        tree[:, size:-1] = np.where(live[:, 1:] & (rank < NONE), rank * size + where[:-1], NONE)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        flat, s, a, b, alive = tree.ravel(), sym.ravel(), after.ravel(), before.ravel(), live.ravel()
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root, base = rows * (2 * size), rows * size
            top = flat[root + 1]
            pos = top % size
            j = a[base + pos]
            k = a[base + j]
            s[base + pos] = top // size
            alive[base + j] = False
            a[base + pos] = k
            has_next = k >= 0
            b[(base + k)[has_next]] = pos[has_next]
            leaf = root + size
            flat[leaf + j] = NONE
            flat[leaf + pos] = self._leaf(s, base, pos, k, has_next, size)
            p = b[base + pos]
            has_prev = p >= 0
            p = np.where(has_prev, p, pos)  # a first symbol writes its own leaf twice
            flat[leaf + p] = np.where(has_prev, self._leaf(s, base, p, pos, has_prev, size), flat[leaf + p])
            node = np.concatenate([size + pos, size + j, size + p])
            owner = np.concatenate([root, root, root])
            for _ in range(size.bit_length() - 1):
                node >>= 1
                flat[owner + node] = np.minimum(flat[owner + 2 * node], flat[owner + 2 * node + 1])
            rows = rows[flat[root + 1] < NONE]
        return sym[live], live.sum(1)

    def _leaf(self, s: np.ndarray, base: np.ndarray, left: np.ndarray, right: np.ndarray, real: np.ndarray, size: int) -> np.ndarray:
        """What the leaf of the pair (left, right) holds."""
        r = self.pair(s[base + left], s[base + np.where(real, right, 0)])
        return np.where(real & (r < NONE), r * size + left, NONE)

    def _long(self, piece: bytes) -> list[int]:
        """One tree for one long piece."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        none = 1 << 62
        sym = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        get, tree = self.pair.of.get, [none] * (2 * size)
        for i in range(n - 1):
            r = get(sym[i] << 20 | sym[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        def pair(i: int, j: int) -> int:
            r = get(sym[i] << 20 | sym[j]) if j >= 0 else None
            return none if r is None else r * size + i

        while tree[1] < none:
            r, i = divmod(tree[1], size)
            j = after[i]
            k = after[j]
            sym[i], sym[j], after[i] = r, -1, k
            if k >= 0:
                before[k] = i
            put(j, none)
            put(i, pair(i, k))
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        return [x for x in sym if x >= 0]


def _finders(pattern: str):
    """The pattern's findall for any text, by the ``regex`` module as it needs Unicode properties,
    and for ASCII texts, where letters and numbers are short ranges, by ``re``."""
    import regex

    within = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), pattern)
    plain = within.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    every = regex.compile(pattern).findall
    return every, every if r"\p" in plain else re.compile(plain, re.ASCII).findall


class _Numbered(dict):
    """The number of each piece met, given when it is first asked for."""

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        return number


class _Encoder:
    """A worker's encoder with the ids of pieces it has met; the store is emptied when full."""

    made: dict[tuple[str, str], _Encoder] = {}

    def __init__(self, path: str, pattern: str):
        self.bpe = SegmentTreeBpe(load_ranks(path))
        self.find, self.find_ascii = _finders(pattern)
        self._empty()

    @classmethod
    def of(cls, path: str, pattern: str) -> _Encoder:
        if (path, pattern) not in cls.made:
            cls.made[path, pattern] = cls(path, pattern)
        return cls.made[path, pattern]

    def _empty(self) -> None:
        self.number, self.held = _Numbered(), 0
        self.flat, self.starts = np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def _learn(self, pieces: list[str], known: int) -> None:
        """Append the ids of new pieces, numbered from ``known``, to the store."""
        raw = [p.encode() for p in pieces]
        ids, count = self.bpe.encode(raw)
        self.held += sum(map(len, raw))
        n, at = known + len(pieces), int(self.starts[known])
        if len(self.starts) <= n:
            self.starts = np.append(self.starts, np.zeros(n + 1, np.int64))
        if len(self.flat) < at + len(ids):
            self.flat = np.append(self.flat, np.empty(at + len(ids), np.int32))
        self.flat[at : at + len(ids)] = ids
        self.starts[known + 1 : n + 1] = at + np.cumsum(count)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.number) > MOST_PIECES or self.held > MOST_BYTES:
            self._empty()
        found = [(self.find_ascii if t.isascii() else self.find)(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        known = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        new = len(self.number) - known
        if new:
            self._learn(list(islice(reversed(self.number), new))[::-1], known)
        ids, each = taken(self.flat, self.starts, numbers)
        ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum(sizes)]
        return np.split(ids, ends[:-1]) if len(ends) else []


class _Decoder:
    """The bytes of ids, and their decimal digits, from tables over the whole vocabulary."""

    made: dict[str, _Decoder] = {}

    def __init__(self, path: str):
        ranks = load_ranks(path)
        tokens, self.known = [b""] * (max(ranks.values()) + 1), np.zeros(max(ranks.values()) + 1, bool)
        for t, r in ranks.items():
            tokens[r] = t
            self.known[r] = True
        self.bytes, self.digits = runs(tokens), runs([b"%d " % i for i in range(len(tokens))])

    @classmethod
    def of(cls, path: str) -> _Decoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def _parts(self, table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> Iterator[bytes]:
        for at in range(0, len(ids), PART):
            part = ids[at : at + PART]
            if part.min() < 0 or part.max() >= len(self.known) or not self.known[part].all():
                raise ValueError("an id is not in the vocabulary")
            yield taken(*table, part)[0].tobytes()

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        return self._parts(self.bytes, ids)

    def listed(self, ids: np.ndarray) -> Iterator[bytes]:
        """The decimal ids, each followed by a space."""
        return self._parts(self.digits, ids)


def _ids_array(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text, without special tokens, as the rank file has them."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Encoder.of(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), _ids_array(own.ids(part.column("text").to_pylist()))], names=[id_col, "ids"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([T.StructField(id_col, plain.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return plain.mapInArrow(run, out)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): the bytes that the ids stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Decoder.of(path)
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), 64):
                part = batch.slice(i, 64)
                lists = part.column("ids")
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                each = np.split(lists.flatten().to_numpy(), ends[:-1]) if len(ends) else []
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array([b"".join(own.decoded(x)) for x in each], pa.binary())], names=[id_col, "ids", "decoded"])

    plain = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    fields = [T.StructField(id_col, plain.schema["id"].dataType), T.StructField("ids", plain.schema["ids"].dataType), T.StructField("decoded", T.BinaryType())]
    return plain.mapInArrow(run, T.StructType(fields))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, then decoded again.

    One pass over the texts, which stay where they are; only digests leave the worker.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _Encoder.of(path, pattern), _Decoder.of(path)
        for batch in batches:
            for part in slices(batch, "text"):
                every = encoder.ids(part.column("text").to_pylist())
                listed, decoded = [], []
                for ids in every:
                    a, b, last = hashlib.sha256(), hashlib.sha256(), b""
                    for x in decoder.listed(ids):
                        a.update(last)
                        last = x
                    a.update(last[:-1])
                    for x in decoder.decoded(ids):
                        b.update(x)
                    listed.append(a.hexdigest())
                    decoded.append(b.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(map(len, every), pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    kinds = [("doc_id", plain.schema["id"].dataType), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return plain.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in kinds]))
