"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes with frozen counts. A byte costs the code length that its
context gives it with escape method C: count / (total + distinct), or an escape and the next shorter context, down to the
uniform code over 256 bytes. The costs are worked out once for every context that some language has seen, so scoring is two
table look-ups a byte and exact. The language with the shortest code wins; the score is its share among the languages' weights,
which are 2 to the power of minus the bits a byte.

Learning reads every language, at most ``per_language`` different rows of each (those with the smallest hash of id and text)
and no more than reach ``language_bytes``. Executors count the grams of a language; the driver gets the counts. The costs take (contexts x bytes seen x languages) floats.

Defined cases: null texts and texts without a letter are ``und`` with score 0; bytes never seen in learning cost the
uniform code; ties go to the language first by name; repeated rows teach once and are scored each; with nothing to learn from
all rows are ``und``; an empty table gives an empty result; other columns pass through, ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import mapped

_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 19


@dataclass(frozen=True)
class Model:
    langs: list[str]
    symbols: np.ndarray  # byte -> symbol; 0: start of text, 1: unseen byte
    nodes: np.ndarray  # three symbols -> the node of their longest suffix that was seen
    costs: np.ndarray  # (node, symbol) -> code length in each language

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        a = len(self.costs) // self.n_nodes
        for i, t in enumerate(texts):
            s = np.concatenate([np.zeros(3, np.int32), self.symbols[np.frombuffer(t, np.uint8)]])
            for k in range(3, len(s), _CHUNK):
                e = min(len(s), k + _CHUNK)
                node = self.nodes[(s[k - 3 : e - 3] * a + s[k - 2 : e - 2]) * a + s[k - 1 : e - 1]]
                out[i] += np.take(self.costs, node * a + s[k:e], axis=0).sum(axis=0, dtype=np.float64)
        return out

    @property
    def n_nodes(self) -> int:
        return int(self.nodes.max()) + 1


def _counts(texts: list[bytes], symbols: np.ndarray, a: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a context of ``order`` symbols and one more, in order, and how often each occurs."""
    codes, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(0, len(texts), 16):
        parts = [codes]
        for t in texts[i : i + 16]:
            s = np.concatenate([np.zeros(3, np.int64), symbols[np.frombuffer(t, np.uint8)]])
            parts.append(sum(s[3 - k : len(s) - k] * a**k for k in range(order + 1)))
        weight = np.concatenate([n, np.ones(sum(map(len, parts[1:])), np.int64)])
        codes, place = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(place, weight, len(codes)).astype(np.int64)
    return codes, n


#: Every byte a symbol of its own, for counting before all languages' bytes are known; 0: start of text.
_BYTES = np.arange(1, 257, dtype=np.int32)


def grams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """A language's tree: for contexts of 0 to 3 bytes, the grams in order and how often each occurs."""
    return [_counts(texts, _BYTES, 257, k) for k in range(4)]


def fit(by_lang: dict[str, list[bytes]]) -> Model:
    return fit_grams({x: grams(texts) for x, texts in by_lang.items()})


def fit_grams(by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Model:
    langs = sorted(by_lang)
    seen = np.unique(np.concatenate([by_lang[x][0][0] for x in langs])).astype(np.int64) - 1
    symbols = np.ones(256, np.int32)
    symbols[seen] = np.arange(2, 2 + len(seen))
    a = 2 + len(seen)
    dense = np.concatenate([np.zeros(1, np.int64), symbols])  # keeps the order of the bytes seen
    tables = [[(sum(dense[codes // 257**j % 257] * a**j for j in range(k + 1)), n) for k, (codes, n) in enumerate(by_lang[x])] for x in langs]
    node, orders, codes = np.zeros(1, np.int32), [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for k in range(1, 4):  # node 0: the empty context; a longer context that nobody has seen is its suffix's node
        own = np.unique(np.concatenate([t[k][0] // a for t in tables]))
        node = np.tile(node, a)
        node[own] = sum(map(len, codes)) + np.arange(len(own))
        orders.append(np.full(len(own), k))
        codes.append(own)
    orders, codes = np.concatenate(orders), np.concatenate(codes)
    costs = np.empty((len(codes), a, len(langs)), np.float32)
    for i, table in enumerate(tables):
        cost = np.full((len(codes), a), 8.0, np.float32)
        for k in range(4):  # from the shortest context to the longest
            own = np.flatnonzero(orders >= k)
            contexts, back = np.unique(codes[own] % a**k, return_inverse=True)
            grams, n = table[k]
            dense = np.zeros((len(contexts), a), np.float32)
            dense[np.searchsorted(contexts, grams // a), grams % a] = n
            for j in range(0, len(own), 4096):  # some rows at a time
                c, rows = dense[back[j : j + 4096]], own[j : j + 4096]
                total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cost[rows] = np.where(total == 0, cost[rows], np.where(c > 0, -np.log2(c / (total + kinds)), cost[rows] - np.log2(kinds / (total + kinds))))
        costs[:, :, i] = cost
    return Model(langs, symbols, node, costs.reshape(-1, len(langs)))


def train(docs: DataFrame, usable: Column, per_language: int = 150, language_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from rows where ``usable`` holds and the language is known, of every language there is."""
    ok = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).where("t <> ''")
    ok = ok.withColumn("h", F.xxhash64("t"))
    found = sampled(ok.groupBy("l", "k", "h").agg(F.max(F.octet_length("t")).alias("size")), "l", per_language, language_bytes)
    chosen = F.broadcast(found.select(*(F.col(c).alias(f"_{c}") for c in ("l", "k", "h"))))  # rows: languages x per_language
    rows = ok.join(chosen, (F.col("l") == F.col("_l")) & F.col("k").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h")), "left_semi").dropDuplicates(["l", "k", "h"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        found = grams([t.encode() for t in pdf["t"]])
        return pd.DataFrame({"l": pdf["l"].iloc[0], "k": range(4), "codes": [c.astype("<i8").tobytes() for c, _ in found], "n": [n.astype("<i8").tobytes() for _, n in found]})

    by_lang: dict[str, list] = {}
    for r in rows.select("l", "t").groupBy("l").applyInPandas(count, "l string, k int, codes binary, n binary").collect():
        by_lang.setdefault(r["l"], [None] * 4)[r["k"]] = (np.frombuffer(r["codes"], "<i8"), np.frombuffer(r["n"], "<i8"))
    return fit_grams(by_lang) if by_lang else None


def sampled(rows: DataFrame, of: str, most: int, most_bytes: int) -> DataFrame:
    """Of distinct (of, k, h, size) the first ``most`` of each ``of`` by a hash, and no more than reach ``most_bytes`` (one
    at least). Each task first picks its own, then some parts of each ``of``, then each ``of`` as a whole."""
    by = (F.xxhash64("k", "h"), "k", "h")
    part = F.pmod(F.xxhash64("h", "k"), F.lit(64))
    rows = rows.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy(of, "part").orderBy(*by))).where(F.col("r") <= most)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(of).orderBy(*by))).where(F.col("r") <= most)
    before = F.sum("size").over(Window.partitionBy(of).orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most_bytes).drop("part", "r", "before", "size")


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The input with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            pred, score = [], []
            for x in batch.column(1):
                t = x.as_py()
                if model is None or not t or not _LETTER.search(t):
                    pred.append("und")
                    score.append(0.0)
                    continue
                data = t.encode("utf-8", "replace")
                bits = model.bits([data])[0]
                best = int(bits.argmin())
                pred.append(model.langs[best])
                score.append(float(1 / np.exp2((bits[best] - bits) / len(data)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["kept", "new_lang_pred", "new_score"])

    return mapped(docs, text, run, {"lang_pred": "string", "score": "double"})
