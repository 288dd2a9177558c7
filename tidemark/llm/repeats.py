"""Strings that also start in a document with a smaller id: the engine of both substring operators.

Documents are dealt into pieces of a few MB of text. Passes go over the pieces, each answered by hash ranges (buckets):

1. *Sketch.* Each piece sends a count-min sketch of its keys: for each of ``depth`` rows the sorted cells and whether one or
   more of its documents have a key there. A bucket adds the pieces' counters up and answers each cell with whether the
   estimate is two documents or more. Estimates never fall short, so a key with an estimate of one has no repeat.
2. *Names.* What is estimated repeated is sent by its exact name (96 or 128 bits), each name once a piece with the piece's
   smallest document. A bucket sorts them and answers with one byte a name.
3. *Extents*, for bytes only (see ``Bytes``).

The last pass marks what is covered and returns the rest. Nothing is lost: what a pass leaves out can't be covered.

What a task holds is bounded by the size of pieces and buckets, whose numbers follow the input, and copies meet as one name
a piece, however many there are; only a single document longer than a piece is a piece of its own size (some 100 bytes of
memory a byte). Each piece sends a row to each bucket, so the number of rows, not their bytes, grows with the square of the
input: 12 million at 30 GB.

Defined cases: null and empty texts have no unit and stay as they are; texts shorter than a window are kept whole; a null id
is larger than any, and null ids don't cover one another; rows of one id don't cover one another, whatever their texts;
repeated rows are judged each; an empty table gives an empty result. Columns pass through under their own names, but
``_units``, ``_removed``, ``_runs`` and ``_kept`` are replaced. Text is taken as UTF-8, what can't be encoded as ``?``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, mix, range_hashes, window_hashes, word_bounds

_NULL = np.iinfo(np.int64).max
_RUN = 1 << 15
#: Answers to a name: nothing, a smaller document has it, its extent is asked for.
NONE, COVERED, ASKED = 0, 1, 2


@dataclass
class Items:
    """What a piece asks about: document (place in the piece), key, and the units [begin, end) that it stands for."""

    doc: np.ndarray
    key: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    n_units: int
    #: Of words the second half of each name; of bytes the place of each key, and the data.
    more: tuple = ()


class Words:
    """Windows of consecutive words, one item each. The key and 32 more bits are the name."""

    extents = False

    def __init__(self, width: int) -> None:
        self.width = width

    def find(self, texts: list[bytes]) -> Items:
        data, s, e, doc = word_bounds(texts)
        same = doc[: max(0, len(s) - self.width + 1)] == doc[self.width - 1 :] if len(s) >= self.width else np.zeros(0, bool)
        i = np.flatnonzero(same)
        first, second = range_hashes(data, s, e)
        return Items(doc[i], window_hashes(first, self.width)[i], i, i + self.width, len(doc), (window_hashes(second, self.width, 1)[i],))

    def second(self, items: Items, use: np.ndarray) -> np.ndarray:
        return items.more[0][use] >> U(32)

    second_type = np.dtype("<u4")

    def judge(self, key: np.ndarray, second: np.ndarray, low: np.ndarray) -> np.ndarray:
        """An answer to each name: whether a smaller document than its own has it."""
        return np.where(_least((key, second), low) < low, COVERED, NONE).astype(np.uint8)

    def leave(self, texts: list[bytes], covered: np.ndarray) -> list[tuple]:
        """(units, removed, runs removed, text kept) of each document."""
        out, at = [], 0
        for t in texts:
            ws = t.split()
            c = covered[at : at + len(ws)]
            at += len(ws)
            n = int(c.sum())
            runs = int((np.diff(np.concatenate([[0], c.view(np.int8)])) == 1).sum()) if n else 0
            out.append((len(ws), n, runs, b" ".join(compress(ws, ~c) if n else ws)))
        return out


class Bytes:
    """Strings of ``width`` bytes, by prefix doubling over a sample of the suffixes.

    Each string elects one of its positions: the start of its smallest half-width string under a hash order (the first, if it
    has several). Equal strings elect the same place, so only elected positions, about 2 of 27, take part. Their rank by half
    a width is the key; equal ranks are sorted together. The next rank doubles the length on both sides: it names the whole
    stretch of text whose strings elect the position, 50 to 75 bytes, as one. Where a smaller document has that stretch,
    all its strings are repeats; where no smaller document has even the key, none is; both are done. What is left, at the
    ends of repeats, is asked for its extent: the bytes about the key are sent, one of each stretch that differs, and ranked
    for each place of the string in turn, which is past the threshold.
    """

    extents = True

    def __init__(self, width: int) -> None:
        self.width, self.half, self.gap = width, width // 2, width - width // 2

    def find(self, texts: list[bytes]) -> Items:
        n, w, h = sum(map(len, texts)), self.width, self.half
        data = np.frombuffer(b"".join(texts) + bytes(w + 8), np.uint8)
        lens = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lens)
        none = np.empty(0, np.int64)
        if n < w:
            return Items(none, none.astype(U), none, none, n, (none, data))
        blocks = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        elected = np.empty(n - w + 1, np.uint32)  # a place for each string
        for i in range(0, len(elected), _RUN):  # runs that fit in a core's cache
            m = min(_RUN, len(elected) - i)
            low = ranks(lambda at: blocks[i + at : i + at + m + self.gap], h)
            low &= U(0xFFFFFFFF00000000)  # ordered by hash, then by place
            low |= np.arange(i, i + len(low), dtype=np.uint32)
            size, need = 1, self.gap + 1
            while size * 2 <= need:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            elected[i : i + m] = np.minimum(low[:m], low[need - size : need - size + m])  # keeps the lower half
        valid = np.zeros(n - w + 2, np.int32)  # strings that lie in one text; one more place that is none
        whole = lens >= w
        np.add.at(valid, (ends - lens)[whole], 1)
        np.add.at(valid, (ends - w + 1)[whole], -1)
        valid = np.cumsum(valid, dtype=np.int32) > 0
        change = np.ones(len(elected), bool)
        change[1:] = (elected[1:] != elected[:-1]) | ~valid[: len(elected) - 1]
        first = np.flatnonzero(change & valid[:-1])
        stop = np.append(change[1:], True) | ~valid[1:]
        last = np.flatnonzero(stop & valid[:-1])
        a = elected[first].astype(np.int64)
        # mixed once more: the smallest of many hashes are small, and would all fall into the first buckets
        return Items(np.searchsorted(ends, first, "right"), mix(ranks(lambda at: blocks[a + at], h)), first, last + w, n, (a, data))

    def second(self, items: Items, use: np.ndarray) -> np.ndarray:
        """The rank of an item's whole stretch, with the place of the key in it."""
        begin, end = items.begin[use], items.end[use]
        return mix(range_hashes(items.more[1], begin, end, 1)[0] + (items.more[0][use] - begin).astype(U))

    second_type = np.dtype("<u8")

    def judge(self, key: np.ndarray, second: np.ndarray, low: np.ndarray) -> np.ndarray:
        whole, half = _least((key, second), low), _least((key,), low)
        open_ = (whole >= low) & (half < low)
        asked = (_least((key,), np.where(open_, -1, 0)) < 0) & (whole >= low)
        return np.where(whole < low, COVERED, np.where(asked, ASKED, NONE)).astype(np.uint8)

    def spans(self, items: Items, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each item the bytes on both sides of its key that its strings reach, the first and the last place of the key
        in them. Bytes beyond their reach are zero."""
        a, g = items.more[0][use], self.gap
        first, last = a - (items.end[use] - self.width), a - items.begin[use]
        cols = np.concatenate([np.arange(-g, 0), self.half + np.arange(g)])
        at = a[:, None] + cols
        inside = (at >= items.begin[use][:, None]) & (at < items.end[use][:, None])
        return np.where(inside, items.more[1][np.where(inside, at, 0)], 0).astype(np.uint8), first.astype(np.uint8), last.astype(np.uint8)

    def extent(self, key: np.ndarray, low: np.ndarray, around: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each item a bit for each place of the key: whether a smaller document has the string with the key there."""
        out = np.zeros(len(key), np.uint32)
        for place in range(self.gap + 1):
            i = np.flatnonzero((first <= place) & (place <= last))
            if len(i):
                rest = np.ascontiguousarray(around[i, self.gap - place : 2 * self.gap - place])
                name = range_hashes(rest.ravel(), np.arange(len(i)) * self.gap, np.arange(1, len(i) + 1) * self.gap, 1)[0]
                out[i] |= (_least((key[i], name), low[i]) < low[i]).astype(np.uint32) << np.uint32(place)
        return out

    def leave(self, texts: list[bytes], covered: np.ndarray) -> list[tuple]:
        out, at = [], 0
        for t in texts:
            c = covered[at : at + len(t)]
            at += len(t)
            n = int(c.sum())
            runs = int((np.diff(np.concatenate([[0], c.view(np.int8)])) == 1).sum()) if n else 0
            out.append((len(t), n, runs, np.frombuffer(t, np.uint8)[~c].tobytes() if n else t))
        return out


def ranks(block, length: int) -> np.ndarray:
    """A hash of ``length`` bytes at several places; block(k) has the eight bytes from each place's k-th on."""
    out = None
    for at in range(0, length, 8):
        x = block(at)
        if length - at < 8:
            x = x & U((1 << 8 * (length - at)) - 1)
        out = x ^ U(0x9E3779B97F4A7C15) if out is None else np.bitwise_xor(out, x, out=out)
        out *= U(0xA0761D6478BD642F)
        out ^= out >> U(29)
    out *= U(0x94D049BB133111EB)
    out ^= out >> U(31)
    return out


def _least(names: tuple[np.ndarray, ...], low: np.ndarray) -> np.ndarray:
    """For each row the smallest ``low`` among the rows of its name."""
    if not len(low):
        return low
    order = np.lexsort(names[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in names])
    out = np.empty(len(low), low.dtype)
    out[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _pack(cells: np.ndarray) -> bytes:
    """Sorted distinct cells: the low byte of each step, and the rest of the steps in unary bits."""
    steps = np.diff(cells, prepend=0)
    stops = np.cumsum((steps >> 8) + 1)
    bits = np.zeros(int(stops[-1]) if len(stops) else 0, bool)
    bits[stops - 1] = True
    return np.int64(len(cells)).tobytes() + (steps & 255).astype(np.uint8).tobytes() + np.packbits(bits).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=8 + n)))
    high = np.diff(stops, prepend=-1) - 1
    return np.cumsum((high << 8) | np.frombuffer(blob, np.uint8, n, 8))


def _ids_in(ids: np.ndarray) -> bytes:
    """Ids as the distinct ones and small places among them."""
    own, place = np.unique(ids, return_inverse=True)
    return np.int64(len(own)).tobytes() + own.tobytes() + place.astype(_place_type(len(own))).tobytes()


def _ids_out(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.int64, n, 8)[np.frombuffer(blob, _place_type(n), offset=8 + 8 * n)]


def _place_type(n: int) -> type:
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> U(32)) * U(n)) >> U(32)).astype(np.int64)


_ASK = "bucket int, layer int, piece int, x binary, y binary, z binary"
_ANSWER = "piece int, step int, bucket int, layer int, x binary"


def _frame(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[t]) for i, (n, t) in enumerate(fields)})


class _Piece:
    """One piece's state, worked out anew in each pass from its rows and the answers so far. ``kind`` holds none of it: a
    worker may keep what a function refers to beyond the task."""

    def __init__(self, kind, table: pa.Table, depth: int, buckets: int, bits: int) -> None:
        ids = table.column("id").to_pylist()
        texts = [(t or "").encode("utf-8", "replace") for t in table.column("t").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (_NULL if ids[i] is None else ids[i], texts[i]))
        self.kind, self.depth, self.buckets, self.bits = kind, depth, buckets, bits
        self.kept = table.column("kept").take(pa.array(order, pa.int64()))
        self.ids = np.array([_NULL if ids[i] is None else ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.number = table.column("piece")[0].as_py() if len(ids) else -1
        self.items = kind.find(self.texts)
        self.mine = self.ids[self.items.doc]
        order = np.argsort(self.items.key, kind="stable")
        key, mine = self.items.key[order], self.mine[order]
        new = np.diff(key, prepend=~key[:1]) != 0 if len(key) else np.zeros(0, bool)
        self.place = np.empty(len(key), np.int64)
        self.place[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.keys = key[at]
        self.many = np.minimum.reduceat(mine, at) < np.maximum.reduceat(mine, at) if len(at) else np.zeros(0, bool)

    def cells(self):
        """For each layer: the bucket and cell of every key's counter, as one number, and the keys in the order of these."""
        bucket = _buckets(self.keys, self.buckets) << self.bits
        for layer in range(self.depth):
            flat = bucket | (mix(self.keys + U(layer + 1)) >> U(64 - self.bits)).astype(np.int64)
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            new = np.diff(flat, prepend=-1) != 0
            cut = np.searchsorted(flat[new] >> self.bits, np.arange(self.buckets + 1))
            yield layer, order, new, flat[new] & ((1 << self.bits) - 1), cut

    def sketch(self) -> list[tuple]:
        out = []
        for layer, order, new, cell, cut in self.cells():
            n = np.add.reduceat(1 + self.many[order], np.flatnonzero(new)) if len(order) else order
            for b in range(self.buckets):
                x, y = cut[b], cut[b + 1]
                if x < y:
                    out.append((b, layer, self.number, _pack(cell[x:y]), np.packbits(n[x:y] > 1).tobytes(), None))
        return out

    def names(self, answers: dict) -> None:
        """The distinct names of what the sketch estimates repeated, in order, with the smallest document of each."""
        repeated = np.ones(len(self.keys), bool)
        for layer, order, new, cell, cut in self.cells():
            flags = np.zeros(len(cell), bool)
            for b in range(self.buckets):
                x, y = cut[b], cut[b + 1]
                if x < y:
                    flags[x:y] = np.unpackbits(np.frombuffer(answers[0, b, layer], np.uint8), count=int(y - x))
            repeated[order] &= flags[np.cumsum(new) - 1]
        self.use = np.flatnonzero(repeated[self.place])
        key, second = self.items.key[self.use], self.kind.second(self.items, self.use)
        order = np.lexsort((second, key))
        key, second, mine = key[order], second[order], self.mine[self.use][order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(new)
        self.name_of = np.empty(len(order), np.int64)
        self.name_of[order] = np.cumsum(new) - 1
        self.key, self.second, self.sample = key[at], second[at], self.use[order[at]]
        self.low = np.minimum.reduceat(mine, at) if len(at) else mine
        self.cut = np.searchsorted(_buckets(self.key, self.buckets), np.arange(self.buckets + 1))

    def ask_names(self) -> list[tuple]:
        cuts = [(b, x, y) for b, (x, y) in enumerate(zip(self.cut[:-1], self.cut[1:])) if x < y]
        second = self.second.astype(self.kind.second_type)
        return [(b, 0, self.number, self.key[x:y].tobytes(), second[x:y].tobytes(), _ids_in(self.low[x:y])) for b, x, y in cuts]

    def judged(self, answers: dict) -> None:
        parts = [answers[1, b, 0] for b in range(self.buckets) if self.cut[b] < self.cut[b + 1]]
        self.code = np.frombuffer(b"".join(parts), np.uint8)

    def ask_extents(self) -> list[tuple]:
        out = []
        for b in range(self.buckets):
            i = self.cut[b] + np.flatnonzero(self.code[self.cut[b] : self.cut[b + 1]] == ASKED)
            if len(i):
                around, first, last = self.kind.spans(self.items, self.sample[i])
                out.append((b, 0, self.number, self.key[i].tobytes() + first.tobytes() + last.tobytes(), around.tobytes(), _ids_in(self.low[i])))
        return out

    def finish(self, answers: dict) -> pa.Table:
        name, doc = self.name_of, self.mine[self.use]
        whole = (self.code[name] == COVERED) | (doc > self.low[name])
        cover = np.zeros(self.items.n_units + 1, np.int32)
        at = self.use[whole]
        np.add.at(cover, self.items.begin[at], 1)
        np.add.at(cover, self.items.end[at], -1)
        if self.kind.extents:
            bits = np.zeros(len(self.key), np.uint32)
            asked = np.flatnonzero(self.code == ASKED)
            found = [answers[2, b, 0] for b in range(self.buckets) if (self.code[self.cut[b] : self.cut[b + 1]] == ASKED).any()]
            bits[asked] = np.frombuffer(b"".join(found), np.uint32)
            rest = np.flatnonzero(~whole & (bits[name] > 0))
            for place in range(self.kind.gap + 1):
                i = rest[(bits[name[rest]] >> np.uint32(place)) & 1 == 1]
                start = self.items.more[0][self.use[i]] - place
                np.add.at(cover, start, 1)
                np.add.at(cover, start + self.kind.width, -1)
        left = self.kind.leave(self.texts, np.cumsum(cover[:-1], dtype=np.int32) > 0)
        kinds = (("units", pa.int64()), ("removed", pa.int64()), ("runs", pa.int64()), ("rest", pa.binary()))
        return pa.table({"kept": self.kept} | {c: pa.array([x[i] for x in left], t) for i, (c, t) in enumerate(kinds)})


def _answers(table: pa.Table) -> dict:
    cols = (table.column(c).to_pylist() for c in ("step", "bucket", "layer", "x"))
    return {(s, b, k): x for s, b, k, x in zip(*cols)}


def covered_text(docs: DataFrame, kind, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, depth: int = 2, bits: int = 23, piece_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``keep`` columns of each row with ``_units``, ``_removed``, ``_runs``, ``_kept`` (binary)."""
    keep = keep or [key]
    total = docs.select(F.sum(F.octet_length(text) + 1).alias("b")).first()["b"] or 1
    n_pieces, n_buckets = max(1, -(-total // piece_bytes)), max(16, -(-total // bucket_bytes))
    n_parts = n_pieces if n_pieces <= 20_000 else max(20_000, n_pieces // 64)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("id", "t"), F.lit(n_pieces)).cast("int")).repartition(n_parts, "piece")

    def piece(table: pa.Table) -> _Piece:
        return _Piece(kind, table, depth, n_buckets, bits)

    def sketch(table: pa.Table) -> pa.Table:
        return _frame(piece(table).sketch(), _ASK)

    def merge(table: pa.Table) -> pa.Table:
        counters, out = np.zeros(1 << bits, np.uint32), []
        cells = [_unpack(x) for x in table.column("x").to_pylist()]
        for c, more in zip(cells, table.column("y").to_pylist()):
            counters[c] += 1 + np.unpackbits(np.frombuffer(more, np.uint8), count=len(c)).astype(np.uint32)
        for c, p in zip(cells, table.column("piece").to_pylist()):
            out.append((p, 0, table.column("bucket")[0].as_py(), table.column("layer")[0].as_py(), np.packbits(counters[c] > 1).tobytes()))
        return _frame(out, _ANSWER)

    def names(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _frame([], _ASK)
        p = piece(table)
        p.names(_answers(answers))
        return _frame(p.ask_names(), _ASK)

    def judge(table: pa.Table) -> pa.Table:
        xs, ys, lows = (table.column(c).to_pylist() for c in ("x", "y", "z"))
        lows = [_ids_out(x) for x in lows]
        code = kind.judge(np.frombuffer(b"".join(xs), U), np.frombuffer(b"".join(ys), kind.second_type), np.concatenate(lows))
        cut = np.cumsum([0, *map(len, lows)])
        b = table.column("bucket")[0].as_py()
        return _frame([(p, 1, b, 0, code[x:y].tobytes()) for p, x, y in zip(table.column("piece").to_pylist(), cut[:-1], cut[1:])], _ANSWER)

    def extents(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _frame([], _ASK)
        p, known = piece(table), _answers(answers)
        p.names(known)
        p.judged(known)
        return _frame(p.ask_extents(), _ASK)

    def extent(table: pa.Table) -> pa.Table:
        lows = [_ids_out(x) for x in table.column("z").to_pylist()]
        heads = table.column("x").to_pylist()
        at = [len(x) for x in lows]
        around = np.frombuffer(b"".join(table.column("y").to_pylist()), np.uint8).reshape(-1, 2 * kind.gap)
        key, first, last = (np.concatenate([np.frombuffer(h, t, n, o * n) for h, n in zip(heads, at)]) for t, o in ((U, 0), (np.uint8, 8), (np.uint8, 9)))
        bits_ = kind.extent(key, np.concatenate(lows), around, first, last)
        cut, b = np.cumsum([0, *at]), table.column("bucket")[0].as_py()
        return _frame([(p, 2, b, 0, bits_[x:y].tobytes()) for p, x, y in zip(table.column("piece").to_pylist(), cut[:-1], cut[1:])], _ANSWER)

    schema = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")).schema
    schema = schema.add("units", "long").add("removed", "long").add("runs", "long").add("rest", "binary")

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        p, known = piece(table), _answers(answers)
        p.names(known)
        p.judged(known)
        return p.finish(known)

    own = rows.groupBy("piece")
    answers = own.applyInArrow(sketch, _ASK).groupBy("bucket", "layer").applyInArrow(merge, _ANSWER)
    asked = own.cogroup(answers.groupBy("piece")).applyInArrow(names, _ASK)
    answers = answers.union(asked.groupBy("bucket").applyInArrow(judge, _ANSWER))
    if kind.extents:
        asked = own.cogroup(answers.groupBy("piece")).applyInArrow(extents, _ASK)
        answers = answers.union(asked.groupBy("bucket").applyInArrow(extent, _ANSWER))
    found = own.cogroup(answers.groupBy("piece")).applyInArrow(finish, schema)
    names_ = {"_units": "units", "_removed": "removed", "_runs": "runs", "_kept": "rest"}
    return found.select(*(F.col(f"kept.`{c}`") for c in keep if c not in names_), *(F.col(v).alias(k) for k, v in names_.items()))
