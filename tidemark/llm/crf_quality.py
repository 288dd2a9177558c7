"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Unary scores are linear in a line's own features and those of the lines before and after it;
transitions tie neighbouring labels. Forward-backward gives each line's probability of being good, and a document's score is
the mean of these, weighted by the lines' bytes. Lines are learned from documents' labels, on at most ``per_label`` documents
of each label (those with the smallest hash of id and text) and no more than reach ``label_bytes`` of text, which bounds what
reaches the driver.

Defined cases: null and empty texts, and texts without a line that has a word, score the learned share of good lines; with
nothing to learn from all rows score 0.5; documents with several labels count with the smallest; repeated rows teach once and
are scored each; a null id or label teaches nothing; an empty table gives an empty result; other columns pass through,
``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import SPACE, range_hashes
from .language import sampled
from .scratch import mapped

_RUN = 1 << 20
_CLASSES = [np.isin(np.arange(256), list(chars)) for chars in (b"#*$%&<>", b"|", b"!", b"0123456789", b".,;:?", bytes(range(65, 91)), bytes(range(97, 123)), b"/@=_{}[]()", bytes(range(128, 256)))]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each line, bytes of each line, features with those of both neighbours) for lines that have a word."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    word = ~SPACE[data]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([[0], np.cumsum(word)])
    n = total[ends] - total[starts]
    some = n > 0
    starts, ends, doc, n = starts[some], ends[some], doc[some], n[some].astype(float)
    if not len(starts):
        return doc, n, np.zeros((0, 0))
    cols = [np.log1p(n)]
    for c in _CLASSES:
        t = np.concatenate([[0], np.cumsum(c[data])])
        cols.append((t[ends] - t[starts]) / n)
    upper2 = np.zeros(len(data), bool)
    upper2[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    t = np.concatenate([[0], np.cumsum(upper2)])
    cols.append((t[ends] - t[starts]) / n)
    first, last = np.searchsorted(s, starts), np.searchsorted(s, ends)
    n_words = (last - first).astype(float)
    h = range_hashes(data, s, e, 1)[0]
    again = np.zeros(len(h) + 1)
    again[2:] = np.cumsum(h[1:] == h[:-1])
    cols.append((again[last] - again[np.minimum(first + 1, last)]) / n_words)
    cols += [np.log1p(n_words), n / n_words, np.isin(data[ends - 1], list(b".!?\"')"))]
    line = range_hashes(data, starts, ends, 1)[0]
    order = np.lexsort((np.arange(len(line)), line, doc))
    same = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    seen = np.zeros(len(line))
    seen[order[1:]] = same
    cols.append(seen)
    own = np.stack([np.asarray(c, float) for c in cols], 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = doc[1:] == doc[:-1]
    before[1:][inner] = own[:-1][inner]
    after[:-1][inner] = own[1:][inner]
    return doc, (ends - starts).astype(float), np.hstack([own, before, after, np.ones((len(own), 1))])


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # score of good against bad
    trans: np.ndarray  # 2 x 2
    prior: float

    def unary(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        doc, size, x = features(texts)
        if len(doc):
            good = marginals(self.unary(x), doc, self.trans)[0]
            top = np.bincount(doc, good * size, len(texts))
            all_ = np.bincount(doc, size, len(texts))
            out[all_ > 0] = top[all_ > 0] / all_[all_ > 0]
        return np.clip(out, 0, 1)


def marginals(unary: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good of each line, and expected transitions summed over all chains: forward-backward over all documents
    at once, one step a line place; only chains that are that long take part in a step."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    lens = np.diff(np.append(starts, len(doc)))
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), "right")
    u = np.exp(np.clip(np.stack([-unary, unary], 1) / 2, -30, 30))
    m = np.exp(trans)
    f, b = np.empty_like(u), np.ones_like(u)
    for t, k in enumerate(live):
        at = starts[:k] + t
        f[at] = u[at] if t == 0 else (f[at - 1] @ m) * u[at]
        f[at] /= f[at].sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(len(live) - 1, 0, -1):
        at = starts[: live[t]] + t
        out = b[at] * u[at]
        joint = f[at - 1][:, :, None] * m * out[:, None, :]
        expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b[at - 1] = out @ m.T
        b[at - 1] /= b[at - 1].sum(1, keepdims=True)
    p = f * b
    return p[:, 1] / p.sum(1), expected


def fit(texts: list[bytes], labels: list[int], steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam, every line labelled as its document."""
    doc, _, x = features(texts)
    y = np.asarray(labels, float)[doc]
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[-1] = 0, 1
    scale[scale == 0] = 1
    model = Crf(mean, scale, np.zeros(x.shape[1]), np.zeros((2, 2)), float(y.mean()))
    z = np.clip((x - mean) / scale, -8, 8)
    inner = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
    theta, m1, m2 = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for k in range(1, steps + 1):
        good, expected = marginals(z @ theta[:-4], doc, theta[-4:].reshape(2, 2))
        g = np.concatenate([z.T @ (y - good), (seen - expected).ravel()]) / len(y) - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
    model.weights, model.trans = theta[:-4], np.clip(theta[-4:].reshape(2, 2), -3, 3)
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = 600, label_bytes: int = 8 << 20, key: str = "doc_id", text: str = "text", label: str = "quality") -> Crf | None:
    marks = labels.where(usable & F.col(label).isin(0, 1)).groupBy(F.col(key).cast("string").alias("k")).agg(F.min(label).alias("y"))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(r"t rlike '[^ \\t\\n\\x0b\\f\\r]'")
    rows = rows.withColumn("h", F.xxhash64("t"))
    known = rows.groupBy("k", "h").agg(F.max(F.octet_length("t")).alias("size")).join(marks, "k")
    chosen = sampled(known, "y", per_label, label_bytes)  # rows: 2 x per_label
    found = rows.join(F.broadcast(chosen), ["k", "h"]).dropDuplicates(["k", "h"]).select("k", "h", "t", "y").collect()
    texts = [(r["t"].encode("utf-8", "replace"), r["y"]) for r in sorted(found, key=lambda r: (r["k"], r["h"]))]
    return fit([t for t, _ in texts], [y for _, y in texts]) if texts else None


def scored(docs: DataFrame, model: Crf | None, text: str = "text") -> DataFrame:
    """The input with ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out, held, size = [], [], 0
            for i, t in enumerate(batch.column(1)):
                held.append((t.as_py() or "").encode("utf-8", "replace"))
                size += len(held[-1])
                if size >= _RUN or i == batch.num_rows - 1:
                    out += ([0.5] * len(held)) if model is None else model.score(held).tolist()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["kept", "new_score"])

    return mapped(docs, text, run, {"score": "double"})
