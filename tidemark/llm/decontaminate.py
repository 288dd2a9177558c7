"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: each task builds, for the rows it holds, the sorted posting list (positions of a term in
the row-after-row sequence of tokens) of every term that some test window has. A window is answered from its rarest term:
that list, less the term's place in the window, is intersected with the other lists, rarest first, each less its own place.
What is left are the exact occurrences. A proximity match of an item asks only that one span of ``slop`` more
words than one of its windows has holds all terms of that window, in any order, each as often as the window does.

Test items go to the tasks in blocks of at most ``block_bytes`` of text, one pass over the rows for each block, so the
broadcast is bounded however large the benchmark is.

Defined cases: null and empty texts have no words and are never hit; items without words have no window; repeated items
and rows count each by itself; a null item id is named ``null``; an empty benchmark or table hits nothing; other columns pass
through, those named ``_n``, ``_spans``, ``_items`` and ``_near`` are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that part words; A to Z go to lower case.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
#: Rows are indexed in runs of about so many bytes.
RUN_BYTES = 4 << 20
#: A proximity match may spread over so many words more than its window has; 0 leaves proximity out.
SLOP = 3
#: The columns that are added.
FOUND = {"_n": "n", "_spans": "spans", "_items": "exact", "_near": "near"}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows_of(item: list[bytes], width: int) -> list[list[bytes]]:
    """All windows of ``width`` consecutive words; the whole item if it is shorter."""
    return [item[i : i + width] for i in range(max(1, len(item) - width + 1))] if item else []


class Postings:
    """The positions of each term in a run of rows; ``ids`` is the run's token sequence, -1 for other words."""

    def __init__(self, ids: np.ndarray, n_terms: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.starts = np.searchsorted(ids[order], np.arange(n_terms + 1))
        self.positions = order

    def __getitem__(self, term: int) -> np.ndarray:
        return self.positions[self.starts[term] : self.starts[term + 1]]

    def phrase(self, window: list[int]) -> np.ndarray:
        """Where the window occurs: offset-adjusted lists, intersected from the rarest."""
        by_length = sorted(range(len(window)), key=lambda k: self.starts[window[k] + 1] - self.starts[window[k]])
        found = self[window[by_length[0]]] - by_length[0]
        for k in by_length[1:]:
            if not len(found):
                break
            found = found[self._has(self[window[k]], found + k)]
        return found

    def near(self, window: list[int], span: int) -> np.ndarray:
        """The places of the window's rarest term that lie in ``span`` words which hold all its terms, each as often as it does."""
        need = Counter(window)
        terms = sorted(need, key=lambda t: self.starts[t + 1] - self.starts[t])
        at = self[terms[0]]
        for t in terms:  # all terms are near enough to the place on either side
            if not len(at):
                return at
            at = at[self._within(t, need[t], at - span + 1, at + span - 1)]
        found = [at[:0]]
        for i in range(0, len(at), 4096):  # one span for all of them
            some = at[i : i + 4096]
            low = some[:, None] - np.arange(span)
            ok = np.ones(low.shape, bool)
            for t in terms:
                ok &= self._within(t, need[t], low, low + span - 1)
            found.append(some[ok.any(axis=1)])
        return np.concatenate(found)

    def _within(self, term: int, n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term occurs ``n`` times from ``low`` to ``high``."""
        own = self[term]
        last = np.searchsorted(own, low) + n - 1
        return (last < len(own)) & (own[np.minimum(last, len(own) - 1)] <= high) if len(own) else np.zeros(low.shape, bool)

    @staticmethod
    def _has(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
        place = np.searchsorted(sorted_list, values)
        place[place == len(sorted_list)] = 0
        return sorted_list[place] == values if len(sorted_list) else np.zeros(len(values), bool)


def _answer(texts: list, terms: dict, windows: list, width: int, slop: int) -> list[dict]:
    """For each text: words, spans [start, end) hit, exact items, near items."""
    get, ids, starts = terms.get, [], []
    gap = width + slop + 1  # so many unknown words between rows: no window or span crosses
    for t in texts:
        starts.append(len(ids))
        ids += [get(w, -1) for w in words(t)]
        ids += [-1] * gap
    starts = np.array([*starts, len(ids)])
    post = Postings(np.array(ids, np.int32), len(terms))
    out = [{"n": int(starts[i + 1] - starts[i] - gap), "spans": [], "exact": set(), "near": set()} for i in range(len(texts))]
    for item, window in windows:
        for p in post.phrase(window):
            d = int(np.searchsorted(starts, p, "right") - 1)
            a = int(p - starts[d])
            out[d]["spans"].append((a, a + len(window)))
            out[d]["exact"].add(item)
    if slop:
        for item, window in windows:
            for d in np.unique(np.searchsorted(starts, post.near(window, len(window) + slop), "right") - 1):
                out[d]["near"].add(item)
    return out


def find(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = SLOP, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` with ``_n`` (words), ``_spans`` (hit spans), ``_items`` (exact) and ``_near`` (item ids as strings)."""
    found = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t"))
    sized = found.select(F.sum(F.octet_length("t") + 64).alias("b")).first()["b"] or 0
    blocks = max(1, -(-int(sized) // block_bytes))
    spans, names = "array<struct<a:int,b:int>>", [c for c in docs.columns if c not in FOUND]
    empty = [F.lit(0).cast("long").alias("n"), F.array().cast(spans).alias("spans"), F.array().cast("array<string>").alias("exact"), F.array().cast("array<string>").alias("near")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("kept"), F.col(f"`{text}`").alias("t"), F.struct(*empty).alias("found"))
    for b in range(blocks):
        part = found.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        terms: dict[bytes, int] = {}
        windows = list(dict.fromkeys((r["i"], tuple(terms.setdefault(w, len(terms)) for w in win)) for r in part for win in windows_of(words(r["t"]), width)))
        sent = docs.sparkSession.sparkContext.broadcast((terms, windows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            terms, windows = sent.value
            for batch in batches:
                texts, was, i = batch.column(1), batch.column(2).to_pylist(), 0
                while i < batch.num_rows:
                    first, held, size = i, [], 0
                    while i < batch.num_rows and (not held or size < RUN_BYTES):
                        held.append(texts[i].as_py())
                        size += len(held[-1] or "")
                        i += 1
                    out = []
                    for g, w in zip(_answer(held, terms, windows, width, slop), was[first:i]):
                        hit = [*w["spans"], *({"a": a, "b": e} for a, e in g["spans"])]
                        out.append({"n": g["n"], "spans": hit, "exact": sorted({*w["exact"], *g["exact"]}), "near": sorted({*w["near"], *g["near"]})})
                    part = batch.slice(first, i - first)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, batch.schema.field(2).type)], names=["kept", "t", "found"])

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*(F.col(f"kept.`{c}`") for c in names), *(F.col(f"found.{v}").alias(k) for k, v in FOUND.items()))


def n_hit(spans: str = "_spans"):
    """The number of words in the union of the spans: a sweep over them in order."""
    return F.aggregate(
        F.array_sort(F.coalesce(F.col(spans), F.array().cast("array<struct<a:int,b:int>>"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
        lambda s: s["n"],
    )
