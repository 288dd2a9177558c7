"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles. Equal texts are one row, named by a 128-bit hash of the text and carrying the smallest id
that has it. The MinHash signature of each, cut into bands, gives buckets, and three steps follow:

1. Inside each bucket the signatures are compared a few values at a time; a pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold falls below the tolerance. What is left gives connected classes of
   *survivors*. A bucket of texts that merely share a common passage falls apart here and joins nothing. Buckets of more
   than ``BUCKET`` texts are cut into blocks, each pair of blocks a task of its own.
2. A class of survivors is cut into blocks of about ``BLOCK`` texts. First each block by itself, then each pair of blocks
   compares signatures in the same way and verifies what is left on the shingle sets. Tasks return link counts and, of the
   links, each text's smallest partner class: a pair of blocks joins the classes that the blocks have already, so that the
   edges of a group grow with its texts and not with their pairs.
3. Connected components of the verified links are the classes.

A pair at the threshold misses all bands with probability (1 - t^rows)^bands, 5e-8 as set, and is pruned with probability of
the order of the tolerance; nothing else loses a link.

Defined cases: null and empty texts and those without a word have no shingle and are classes of their own, apart from equal
texts, which share a class; texts of fewer words than a shingle are one shingle; rows with one id are one document, which
joins the classes of all its texts, with the smallest of their representatives and the sums of their counts; an empty table
gives an empty result; a null id is left out, since a class can't name it. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, range_hashes, whole_groups, window_hashes, word_bounds
from .scratch import written

BANDS, ROWS, BLOCK, BUCKET = 32, 4, 256, 2048
HASHES = BANDS * ROWS
_STEP = 16
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash) of every shingle, in the order of the texts."""
    data, s, e, doc = word_bounds(texts)
    words = range_hashes(data, s, e, 1)[0]
    inside = doc[: max(0, len(s) - width + 1)] == doc[width - 1 :] if len(s) >= width else np.zeros(0, bool)
    docs, hashes = [doc[: len(inside)][inside]], [window_hashes(words, width)[inside]]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = np.diff(first)
    for size in range(1, width):  # texts that are shorter than a shingle
        at = np.flatnonzero(n == size)
        if len(at):
            docs.append(at)
            hashes.append(window_hashes(words[(first[at][:, None] + np.arange(size)).ravel()], size)[::size])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def signatures(texts: list[bytes], width: int) -> list[bytes | None]:
    """HASHES 32-bit MinHash values of each text; None without a shingle."""
    doc, h = shingles(texts, width)
    out: list[bytes | None] = [None] * len(texts)
    if len(h):
        at = np.flatnonzero(np.diff(doc, prepend=-1))
        sig = np.empty((len(at), HASHES), np.uint32)
        for k, seed in enumerate(_SEEDS):
            x = h * seed
            sig[:, k] = np.minimum.reduceat((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), at) >> np.uint64(32)
        for row, d in enumerate(doc[at]):
            out[d] = sig[row].tobytes()
    return out


@lru_cache(maxsize=8)
def needed(threshold: float, tolerance: float, bits: int = 32) -> tuple[int, ...]:
    """For each number of compared values, the fewest equal ones with which P(similarity >= threshold) is at least the
    tolerance, under a flat prior; of values kept to ``bits`` bits some are equal by chance."""
    grid = (np.arange(2000) + 0.5) / 2000
    equal = grid + (1 - grid) / 2**bits
    out = []
    for n in range(_STEP, HASHES + 1, _STEP):
        for m in range(n + 1):
            w = m * np.log(equal) + (n - m) * np.log1p(-equal)
            w = np.exp(w - w.max())
            if w[grid >= threshold].sum() >= tolerance * w.sum():
                break
        out.append(m)
    return tuple(out)


def survivors(one: np.ndarray, other: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """The rows of ``other`` that may reach the threshold with ``one`` (a row for each, or one for all)."""
    at, agree = np.arange(len(other)), np.zeros(len(other), np.int16)
    for k, m in enumerate(least):
        cols = slice(k * _STEP, (k + 1) * _STEP)
        agree += (other[at, cols] == (one[cols] if one.ndim == 1 else one[at, cols])).sum(axis=1, dtype=np.int16)
        keep = agree >= m
        at, agree = at[keep], agree[keep]
        if not len(at):
            break
    return at


def _classes(low: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """For each row the first row of its class of survivors. A row is compared with those that no class has yet."""
    label, rest = np.zeros(len(low), np.int64), np.arange(len(low))
    while len(rest):
        first, queue = rest[0], [rest[0]]
        label[first], rest = first, rest[1:]
        while queue and len(rest):
            hit = survivors(low[queue.pop()], low[rest], least)
            label[rest[hit]] = first
            queue.extend(rest[hit].tolist())
            rest = np.delete(rest, hit)
    return label


def _joined(left: np.ndarray, right: np.ndarray, low: np.ndarray, least: tuple[int, ...]) -> list[tuple[int, int]]:
    """Pairs (row, row) that join classes of the left rows with classes of the right ones, one for each join."""
    a, b = left[_classes(low[left], least)], right[_classes(low[right], least)]
    top = {int(x): int(x) for x in (*a, *b)}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for i, x in zip(left, a):
        roots = np.array([find(int(y)) for y in b])
        rest = np.flatnonzero(roots != find(int(x)))
        if not len(rest):
            continue
        for j in survivors(low[i], low[right[rest]], least):
            x_top, y_top = find(int(x)), find(int(b[rest[j]]))
            if x_top != y_top:
                top[max(x_top, y_top)] = min(x_top, y_top)
                out.append((x_top, y_top))
    return out


def bucket_edges(low: np.ndarray, ids: np.ndarray, left: np.ndarray, starts: np.ndarray, same: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the survivors of each group starts[i]:starts[i + 1]: of a bucket or block, each row with its
    class's first; of a pair of blocks (not ``same``), one for each two classes that it joins."""
    size = np.diff(starts)
    two = starts[:-1][(size == 2) & same]
    hit = two[survivors(low[two], low[two + 1], least)]
    a, b = [ids[hit + 1]], [ids[hit]]
    for g in np.flatnonzero((size > 2) | ((size == 2) & ~same)):
        at = np.arange(starts[g], starts[g + 1])
        if same[g]:
            a.append(ids[at])
            b.append(ids[at[_classes(low[at], least)]])
        else:
            pairs = _joined(at[left[at]], at[~left[at]], low, least)
            a.append(ids[[p[0] for p in pairs]])
            b.append(ids[[p[1] for p in pairs]])
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def links(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The verified pairs (left place, right place) of one block pair; of a block with itself, each pair once."""
    agree = np.zeros((len(left), len(right)), np.int16)
    alive = np.triu(np.ones(agree.shape, bool), 1) if same else np.ones(agree.shape, bool)
    for k, least in enumerate(needed(threshold, tolerance)):
        for c in range(k * _STEP, (k + 1) * _STEP):
            agree += sig[left, c][:, None] == sig[right, c][None, :]
        alive &= agree >= least
        if not alive.any():
            break
    x, y = np.nonzero(alive)
    if not len(x):
        return x, y
    used = np.unique(np.concatenate([left[x], right[y]]))
    terms, place = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    sizes = np.array([len(sets[i]) for i in used])
    owner = np.repeat(np.arange(len(used)), sizes)
    rx, ry = np.searchsorted(used, left[x]), np.searchsorted(used, right[y])
    if len(x) * 4 < len(used) or len(used) * 256 > len(x) * 512:  # few pairs: each by itself
        cut = np.concatenate([[0], np.cumsum(sizes)])
        common = np.array([len(np.intersect1d(place[cut[a] : cut[a + 1]], place[cut[b] : cut[b + 1]], assume_unique=True)) for a, b in zip(rx, ry)])
    else:  # many: products of membership matrices, some terms at a time
        total = np.zeros((len(used), len(used)), np.float32)
        for lo in range(0, len(terms), 4096):
            own = (place >= lo) & (place < lo + 4096)
            m = np.zeros((len(used), min(4096, len(terms) - lo)), np.float32)
            m[owner[own], place[own] - lo] = 1
            total += m @ m.T
        common = total[rx, ry].astype(np.int64)
    ok = common >= threshold * (sizes[rx] + sizes[ry] - common) - 1e-9
    return x[ok], y[ok]


def least_of_class(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """For each node of the edges a - b the smallest node that it is connected with."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        top[max(x, y)] = min(x, y)
    return {x: find(x) for x in top}


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id in an edge; comp is the smallest id. Labels sink along edges and through labels' labels; each round ends in a written table."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = written(both.union(both.select("y", "x")).distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = labels.join(near, "x").select("x", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jump = step.select(F.col("x").alias("l"), F.col("l").alias("j"))
        new = written(step.join(jump, "l", "left").select("x", F.least("l", F.coalesce("j", "l")).alias("l"), "was"), "labels")
        done = new.where("l <> was").isEmpty()
        labels = new.select("x", "l")
        if done:
            return labels.select(F.col("x").alias("id"), F.col("l").alias("comp"))


def _matrix(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _signed(rows: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(h, rep, copies, sig, low) of each text with a shingle; ``low`` has the lowest byte of each value of ``sig``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))  # copies in a run are signed once
                sig = signatures([t.encode("utf-8", "replace") for t in texts.values()], width)
                low = [x if x is None else np.frombuffer(x, np.uint8)[::4].tobytes() for x in sig]
                yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.binary()), pa.array(sig, pa.binary()), pa.array(low, pa.binary())], names=["h", "sig", "low"])

    signed = rows.select("h", "t").mapInArrow(sign, "h binary, sig binary, low binary").where("sig IS NOT NULL")
    return signed.dropDuplicates(["h"]).join(reps, "h")


def _survivor_edges(signed: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): edges whose components hold every pair of representatives that shares a band and survives pruning."""
    least = needed(threshold, tolerance, 8)
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    bands = signed.select("rep", "sig", band).select("rep", F.xxhash64("band", F.substring("sig", F.col("band") * 4 * ROWS + 1, F.lit(4 * ROWS))).alias("k"))
    shared = written(bands.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "buckets")
    hits = bands.join(shared, "k").join(signed.select("rep", "low"), "rep")
    hits = hits.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hits = hits.select("k", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "block", "rep", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["k", "p", "q"]):
            p, q, block, rep = (table.column(c).to_numpy() for c in ("p", "q", "block", "rep"))
            a, b = bucket_edges(_matrix(table.column("low"), np.uint8, HASHES), rep, block == p, starts, (p == q)[starts[:-1]], least)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_EDGES)

    return hits.repartition("k", "p", "q").sortWithinPartitions("k", "p", "q", "rep").mapInArrow(run, "a long, b long").distinct()


def _verify(batches: Iterator[pa.RecordBatch], keys: list[str], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Of each group of rows (rep, side, label, copies, sig, sh): links between the sides, or inside the only one. Gives
    (rep, null, number of linked documents) and (label, smallest label joined with it, null)."""
    for table, starts in whole_groups(batches, keys):
        rep, side, label, copies = (table.column(c).to_numpy() for c in ("rep", "side", "label", "copies"))
        out: list[list] = [[], [], []]
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s < 2:
                continue
            part = table.slice(s, e - s)
            own, names, to = rep[s:e], label[s:e], copies[s:e]
            sig, sets = _matrix(part.column("sig"), np.uint32, HASHES), [np.frombuffer(x, np.uint64) for x in part.column("sh").to_pylist()]
            left, right = np.flatnonzero(~side[s:e]), np.flatnonzero(side[s:e])
            same = not len(right)
            if same:
                right = left
            if not len(left):
                continue
            x, y = links(sig, sets, left, right, same, threshold, tolerance)
            a, b = left[x], right[y]
            n = (np.bincount(a, to[b], e - s) + np.bincount(b, to[a], e - s)).astype(np.int64)
            linked = np.flatnonzero(n)
            joins = {k: v for k, v in least_of_class(names[a], names[b]).items() if k != v}
            out[0] += [*own[linked].tolist(), *joins]
            out[1] += [*[None] * len(linked), *joins.values()]
            out[2] += [*n[linked].tolist(), *[None] * len(joins)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_FOUND)


def _links(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b, n) from each block of a class of survivors by itself, then from each pair of its blocks. Give a written table."""
    fields = ["comp", "p", "q", "rep", "side", "label", "copies", "sig", "sh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _verify(batches, ["comp", "p", "q"], threshold, tolerance)

    def verified(rows: DataFrame, name: str) -> DataFrame:
        dealt = rows.select(*fields).repartition("comp", "p", "q").sortWithinPartitions("comp", "p", "q", "rep")
        return written(dealt.mapInArrow(run, "a long, b long, n long"), name)

    alone = members.withColumns({"p": F.col("block"), "q": F.col("block"), "side": F.lit(False), "label": F.col("rep")})
    within = verified(alone, "within")
    names = within.where("b IS NOT NULL").select(F.col("a").alias("rep"), F.col("b").alias("own"))
    several = members.where("blocks > 1").join(names, "rep", "left").withColumn("label", F.coalesce("own", "rep"))
    pairs = several.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("o <> block")
    pairs = pairs.withColumns({"p": F.least("block", "o"), "q": F.greatest("block", "o"), "side": F.col("block") > F.col("o")})
    return within.unionByName(verified(pairs, "between"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, rep_id, n_copies, n_links) of each document: its class's smallest id, the smallest id with its text, the documents with its text, and the documents of other texts linked to it."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.unhex(F.substring(F.sha2("t", 256), 1, 32)))
    copies = written(rows.select("id", "h").distinct(), "copies")
    reps = written(copies.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    signed = written(_signed(rows, reps, width), "signed")
    comps = components(_survivor_edges(signed, threshold, tolerance))
    sizes = comps.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = signed.join(comps.withColumnRenamed("id", "rep"), "rep").join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = written(members.select("comp", "blocks", "block", "rep", "h", "copies", "sig"), "members")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles([t.encode("utf-8", "replace")], width)[1]).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["h", "sh"])

    asked = rows.join(members.select("h", F.col("rep").alias("id")), ["h", "id"], "left_semi").select("h", "t")
    sets = asked.mapInArrow(cut, "h binary, sh binary").dropDuplicates(["h"])
    found = _links(written(members.join(sets, "h").drop("h"), "sets"), threshold, tolerance)
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    several = copies.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    owned = copies.join(several, "id").join(reps, "h").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    classes = components(found.where("b IS NOT NULL").select("a", "b").union(owned)).select(F.col("id").alias("rep"), F.col("comp").alias("class_id"))
    texts = reps.join(classes, "rep", "left").join(counts, "rep", "left")
    texts = written(texts.select("h", "rep", "copies", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "texts")
    out = copies.join(texts, "h").groupBy("id")
    return out.agg(F.min("class_id").alias("class_id"), F.min("rep").alias("rep_id"), F.sum("copies").alias("n_copies"), F.sum("n_links").cast("long").alias("n_links")).withColumnRenamed("id", key)
