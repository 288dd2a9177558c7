"""Best-fit packing of token pieces, improved by a swap-based local search.

Texts become token ids word by word through a bounded memo (the tokenizer never joins words across ASCII white space),
documents longer than the capacity are cut into pieces, and pieces are dealt by hash into groups of bounded size. In a
group, best fit in decreasing order gives the first packing; then documents are moved and exchanged one for one and two
for one between underfull bins wherever that raises the sum of squared fills, until bins empty or the emptiest can't improve.

Defined cases: null and empty texts are one piece, the end token alone; rows repeated in full stay apart by a row number
given within their group; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of which a process remembers the ids, and the bytes of text that it splits at once.
MEMO_WORDS, RUN_BYTES = 500_000, 1 << 20
#: Bins that a round of the local search tries to empty; a bound on the search, not on the pieces.
DONORS = 8
PUNCTUATION = string.punctuation.encode()


class WordIds:
    """Token ids of texts as little-endian bytes, for a tokenizer that lowers case and parts words at white space.

    ASCII punctuation after an ASCII letter or digit is parted from it, so a word's ids are those of its stem and its tail.
    A stem of ASCII letters is one word to the model, which is then asked itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to the cluster's tasks
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), {}

    def _learn(self, new: set[bytes]) -> None:
        memo, cut = self.memo, {}
        for w in new:
            stem = w.rstrip(PUNCTUATION)
            if len(stem) < len(w) and stem and (48 <= stem[-1] <= 57 or 97 <= stem[-1] <= 122) and b"<|" not in w:
                cut[w] = stem, w[len(stem) :]
        plain = (new - cut.keys()).union(*cut.values())
        tokenize, rest = self.tokenizer.model.tokenize, []
        for w in plain:
            if w in memo:
                continue
            if w.isalpha() and w.islower():
                memo[w] = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            memo[w] = array("I", e.ids).tobytes()
        for w, (stem, tail) in cut.items():
            memo[w] = memo[stem] + memo[tail]

    def many(self, texts: list[str]) -> list[bytes]:
        split = [(b if b"<|" in (b := t.encode("utf-8", "replace")) else b.lower()).split() for t in texts]
        memo = self.memo
        new = {w for ws in split for w in ws if w not in memo}
        if len(memo) + len(new) > MEMO_WORDS:  # short words are the common ones
            short = {w: i for w, i in memo.items() if len(w) <= 8} if len(memo) > MEMO_WORDS // 2 else {}
            memo.clear()
            memo.update(short if len(short) <= MEMO_WORDS // 2 else {})
            new = {w for ws in split for w in ws if w not in memo}
        if new:
            self._learn(new)
        return [b"".join([memo[w] for w in ws]) for ws in split]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """This process's own, so that its tasks share what is remembered."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document, its ids followed by ``end``."""
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = word_ids(path), array("I", [end]).tobytes()
        for batch in batches:
            rows, keys, texts, i = [], batch.column(0).to_pylist(), batch.column(1), 0
            while i < len(keys):
                held, size, first = [], 0, i
                while i < len(keys) and (not held or size < RUN_BYTES):
                    held.append(texts[i].as_py() or "")
                    size += len(held[-1])
                    i += 1
                for k, ids in zip(keys[first:i], ids_of.many(held)):
                    ids += last
                    for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        rows.append((k, p, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, f"`{key}` long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that has room. Free room is a bit of an integer."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room_bits = mask >> n
        if room_bits:
            room = n + (room_bits & -room_bits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room.setdefault(room - n, []).append(b)
        mask |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, donors: int = DONORS) -> list[list[int]]:
    """Moves and exchanges between underfull bins, emptiest first, each raising the sum of squared fills. A round tries to
    empty the ``donors`` emptiest bins into all others; the search ends with a round in which none of them gave anything,
    or at the fewest bins that the total allows."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    total = sum(fill)
    changed = True
    while changed and len(bins) > -(-total // capacity):
        changed = False
        order = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
        for a in order[:donors]:
            for b in reversed(order):
                if a == b or not bins[a] or fill[b] < fill[a] or fill[b] == capacity:
                    continue
                gap = capacity - fill[b]
                move = max((i for i in bins[a] if lengths[i] <= gap), key=lambda i: lengths[i], default=None)
                if move is not None:  # move
                    bins[a].remove(move)
                    bins[b].append(move)
                    d = lengths[move]
                else:
                    best = None
                    own = sorted((lengths[j], j) for j in bins[b])
                    for k, i in enumerate(bins[a]):
                        pairs = [(lengths[i], (i,))] + [(lengths[i] + lengths[x], (i, x)) for x in bins[a][k + 1 :]]
                        for n, out in pairs:  # one for one, two for one: the smallest partner that the gap allows
                            at = bisect_left(own, (n - gap, -1))
                            if at < len(own) and own[at][0] < n and (best is None or n - own[at][0] > best[0]):
                                best = (n - own[at][0], out, own[at][1])
                    if best is None:
                        continue
                    d, out, back = best
                    bins[a] = [i for i in bins[a] if i not in out] + [back]
                    bins[b] = [j for j in bins[b] if j != back] + list(out)
                fill[a] -= d
                fill[b] += d
                changed = True
        full = [k for k in range(len(bins)) if bins[k]]
        bins, fill = [bins[k] for k in full], [fill[k] for k in full]
    return bins


def pack(pieced: DataFrame, capacity: int = 4096, group_pieces: int = 40_000) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``pieced`` is counted and read again: give a written table."""
    names = pieced.columns
    groups = max(1, -(-pieced.count() // group_pieces))
    dealt = pieced.withColumn("_g", F.pmod(F.xxhash64(*names), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, kind="stable", ignore_index=True)
        lengths = pdf["length"].tolist()
        seq, off = [0] * len(pdf), [0] * len(pdf)
        first = int(pdf["_g"].iloc[0]) << 32
        for n, b in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in sorted(b):
                seq[i], off[i] = first + n, at
                at += lengths[i]
        return pdf[names].assign(sequence_id=seq, offset=off)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieced.schema)
    return dealt.groupBy("_g").applyInPandas(run, f"{kinds}, sequence_id long, offset long")
