"""Hashes of many byte ranges at once, and groups of rows out of sorted Arrow batches.

A range is read in blocks of eight bytes, each chained through a mixer that can be undone, so two ranges of one length get
the same 64 bits only by chance; sums of powers, for which unlike ranges with equal sums can be written down, are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: White space in ASCII.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SEEDS = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
_STEPS = (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Ranges of more bytes are hashed one by one.
LONG = 512


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, halves: int = 2) -> list[np.ndarray]:
    """For each range data[start:end] ``halves`` independent 64-bit hashes."""
    n = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = [mix(n.astype(U) + seed) for seed in _SEEDS[:halves]]
    live, short = np.flatnonzero((n > 0) & (n <= LONG)), n
    at = 0
    while len(live):
        x = blocks[starts[live] + at] & _MASK[np.minimum(short[live] - at, 8)]
        for h, step in zip(out, _STEPS):
            h[live] = mix((h[live] ^ x) * step + step)
        at += 8
        live = live[short[live] > at]
    for i in np.flatnonzero(n > LONG):
        whole = xxhash.xxh3_128_digest(data[starts[i] : ends[i]].tobytes())
        for h, x in zip(out, np.frombuffer(whole, "<u8")):
            h[i] = x
    return out


def window_hashes(units: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``width`` consecutive values: their sum under odd multipliers of their places, mixed."""
    odd = mix(np.arange(1, width + 1, dtype=U) + _SEEDS[seed]) | U(1)
    n = max(0, len(units) - width + 1)
    total = np.zeros(n, U)
    for j in range(width):
        total += units[j : j + n] * odd[j]
    return mix(total)


def word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array, and for each word its start, its end and its text's place."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.diff(np.concatenate([[0], (~SPACE[data]).view(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return data, s, e, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), s, "right")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold groups of equal ``keys`` whole, and where each group starts (with the end), out of batches in which
    equal keys follow one another. No more is held than a batch and the group that goes on beyond it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and tuple(c[0] for c in cols) != last
        last = tuple(c[-1] for c in cols)
        cut = int(np.flatnonzero(new)[-1]) if new.any() else -1
        if cut < 0:
            held.append(batch)
            continue
        held.append(batch.slice(0, cut))
        yield _grouped(held, keys)
        held = [batch.slice(cut)]
    if held:
        yield _grouped(held, keys)


def _grouped(held: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held)
    new = np.zeros(table.num_rows + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:-1] |= c[1:] != c[:-1]
    return table, np.flatnonzero(new)
