"""Hard cases: clashing names, repeated rows, hot samples, hostile names, and the registered queries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crf_quality, decontaminate, jaccard, language, quality_rules, queries, repeats, stages

from .test_llm import ODD, docs, prose

CLASHES = ("_n", "_spans", "_items", "_lines", "_w", "_good", "_id", "_text", "_piece", "kept", "t", "id", "piece", "found", "h", "score")


def clashing(df):
    return df.select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


def passed(df, but=()):
    rows = df.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES if c not in but)
    return rows


def test_clashing_columns_pass_through(spark):
    table = clashing(docs(spark, [*ODD, prose(1, 60), prose(1, 60)]))
    items = spark.createDataFrame([(None, prose(1, 20)), (3, prose(1, 20))], "item_id long, text string")
    passed(quality_rules.judged(table))
    passed(repeats.covered_text(table, repeats.Words(13), keep=table.columns))
    hit = passed(decontaminate.find(table, items), {"_n", "_spans", "_items"})
    assert [r["_items"] for r in hit][-2:] == [["3", "null"]] * 2 and hit[0]["_n"] == 0
    passed(language.identify(table, language.fit({"en": [b"abc"]})), {"score"})
    assert [r["score"] for r in passed(crf_quality.scored(table, None), {"score"})] == [0.5] * (len(ODD) + 2)
    assert sum(r["doc_id"] in (7, 8) for r in passed(stages.near_duplicate_stage(spark, table, ""))) == 1
    assert len(passed(stages.substring_stage(spark, table.withColumn("n_chars", F.lit(1)), ""))) == len(ODD) + 2


def test_samples_keep_every_class(spark):
    hot = [(1, "aa bb " * 20, "de")] * 700 + [(k + 2, f"cc dd {k} " * 9, "en") for k in range(40)]
    table = spark.createDataFrame(hot, "doc_id long, text string, lang string")
    model = language.train(table, F.lit(True))
    assert model.langs == ["de", "en"]
    small = language.train(table, F.lit(True), per_language=3, language_bytes=100)
    assert small.langs == ["de", "en"]
    labels = spark.createDataFrame([(1, 0), *((k + 2, 1) for k in range(40))], "doc_id long, quality int")
    assert crf_quality.train(table, labels, F.lit(True)).prior > 0.9
    assert 0 < crf_quality.train(table, labels, F.lit(True), per_label=1).prior < 1


def test_names_are_not_sums(spark):
    def thue(n, flip):
        s = [0]
        while len(s) < n:
            s += [1 - x for x in s]
        return "".join("ab"[x ^ flip] for x in s)

    lead = " ".join(f"w{k}" for k in range(12))
    table = docs(spark, [f"{lead} {thue(1024, 0)}", f"{lead} {thue(1024, 1)}"])
    assert [r["_removed"] for r in repeats.covered_text(table, repeats.Words(13)).collect()] == [0, 0]


def test_elected_places_match_brute_force():
    r, kind = random.Random(1), repeats.Bytes(50)
    texts = ["".join(r.choice("ab ") for _ in range(r.randrange(160))).encode() for _ in range(60)] + [b"a" * 300, b"ab" * 60, b""]
    data, want, at = b"".join(texts), {}, 0
    blocks = np.ndarray(len(data) + 51, "<u8", data + bytes(58), strides=(1,))
    rank = repeats.ranks(lambda k: blocks[k : k + len(data) - 24], 25) >> np.uint64(32)
    for d, t in enumerate(texts):
        for p in range(at, at + len(t) - 49):
            want.setdefault((d, min(range(p, p + 26), key=lambda j: (rank[j], j))), []).append(p)
        at += len(t)
    items = kind.find(texts)
    assert {(d, a): list(range(b, e - 49)) for d, a, b, e in zip(items.doc.tolist(), items.more[0].tolist(), items.begin.tolist(), items.end.tolist())} == want


def test_sketch_codes_round_trip():
    for cells in (np.arange(0), np.array([0]), np.array([255, 256, 1 << 22]), np.unique(np.random.default_rng(1).integers(0, 1 << 23, 5000))):
        assert repeats._unpack(repeats._pack(cells)).tolist() == cells.tolist()


def test_ids_with_two_texts_lose_no_link(spark):
    a, b = prose(1, 100), prose(2, 100)
    got = jaccard.near_duplicates(docs(spark, [a, b, b + " z", a + " z", a, b], [1, 1, 2, 3, 7, 7])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["class_id"], r["n_links"]) for r in got] == [(1, 1, 4), (2, 1, 2), (3, 1, 2), (7, 1, 4)]


def test_blocks_of_a_group_are_joined(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    base, texts = prose(1, 100, 10**6).split(), []
    for i in range(60):
        w = list(base)
        w[3 * i % 100] = f"q{i}"
        texts.append(" ".join(w))
    got = jaccard.near_duplicates(docs(spark, texts)).collect()
    sets = [{tuple(w[i : i + 5]) for i in range(96)} for w in (t.split() for t in texts)]
    links = [sum(x is not y and len(x & y) >= 0.8 * len(x | y) for y in sets) for x in sets]
    assert {r["class_id"] for r in got} == {0} and [r["n_links"] for r in sorted(got)] == links


@pytest.mark.parametrize("n", [512, 1024])
def test_edges_grow_with_texts(n):
    low = np.random.default_rng(1).integers(0, 256, (1, jaccard.HASHES)).astype(np.uint8).repeat(n, 0)
    least, ids = jaccard.needed(0.8, 1e-6, 8), np.arange(n)
    a, _ = jaccard.bucket_edges(low, ids, np.ones(n, bool), np.array([0, n]), np.array([True]), least)
    b, _ = jaccard.bucket_edges(low, ids, ids < n // 2, np.array([0, n]), np.array([False]), least)
    assert len(a) == n - 1 and len(b) == 1


def saved(spark, folder, texts, ids=None):
    docs(spark, texts, ids).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def brute(texts, width, split):
    first, out = {}, {}
    for i, t in sorted(texts.items()):
        u = (t or "").encode()
        u = u.split() if split else u
        hit = np.zeros(len(u), bool)
        wins = [tuple(u[k : k + width]) for k in range(len(u) - width + 1)]
        for k, w in enumerate(wins):
            hit[k : k + width] |= first.get(w, i) < i
        for w in wins:
            first.setdefault(w, i)
        left = [x for x, h in zip(u, hit) if not h]
        kept = b" ".join(left) if split else bytes(left)
        out[i] = (len(u), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_registered_repeats(spark, tmp_path):
    r, shared = random.Random(4), prose(9, 70)
    texts = [*ODD, shared, shared, *(f"{prose(k, 30)} {shared[r.randrange(99):r.randrange(150, 380)]} {prose(k + 50, 30)} {shared[:90]}" for k in range(25))]
    folder = saved(spark, tmp_path / "d", texts)
    for name, width, split in (("op2_suffix_dedup", 50, False), ("op8_substring_dedup", 13, True)):
        want = brute(dict(enumerate(texts)), width, split)
        for x in queries.queries()[name](spark, folder).collect():
            n, gone, runs, kept = want[x["doc_id"]]
            assert (x["n_bytes" if not split else "n_words"], x["n_removed"], x["kept_sha256"]) == (n, gone, kept)
            assert split or x["n_spans"] == runs
    empty = saved(spark, tmp_path / "e", [])
    assert queries.op2_suffix_dedup(spark, empty).count() == queries.op10_jaccard_join(spark, empty).count() == 0


def test_registered_decontamination(spark, tmp_path):
    item = [f"v{k}" for k in range(25)]
    texts = [None, "", " ".join(item[4:16]) + " x", "Short, ITEM short item", " ".join(item), prose(1, 40)]
    folder = saved(spark, tmp_path / "d", texts)
    spark.createDataFrame([(2, " ".join(item)), (10, " ".join(item)), (3, "short item"), (4, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = queries.op4_decontaminate(spark, folder).orderBy("doc_id").collect()
    want = [(0, 0, []), (0, 0, []), (13, 12, ["10", "2"]), (4, 4, ["3"]), (25, 25, ["10", "2"]), (40, 0, [])]
    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for _, _, x in want]
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got] == [(n, h, len(x), s, h > 0) for (n, h, x), s in zip(want, sha)]


def test_registered_models(spark, tmp_path):
    texts = [f"the cat sat on the mat {k}" if k % 2 else f"der hund lief in den wald {k}" for k in range(80)] + [None, "123"]
    table = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de")).select("doc_id", "text", "lang")
    table.union(spark.createDataFrame([(None, "the cat", "en")], table.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op3_language(spark, str(tmp_path)).collect()
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert r["lang_pred"] == ("en" if i is None else "und" if i >= 80 else ("de", "en")[i % 2])
    got = queries.op9_crf_quality(spark, str(tmp_path)).collect()
    assert len(got) == 83 and all(r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    import duckdb

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    near = "alpha beta gamma delta x epsilon zeta eta theta iota kappa"
    base = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \n\t ", "one", "ÿ É\x0b日本 é", item.upper(), near, f"{item} {item}", base, base, base.replace("w30", "v"), base + "\nBUY NOW CHEAP x\n\n| a | b |", "a b c a b c d\nx\nx", "Short Item", "the the the the " * 20, "!!!! " * 55]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("a", item), ("b", "short item"), (None, "zeta eta"), ("c", None), ("d", "?!"), ("a", item)], "item_id string, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    for name in ("op1_sharding", "op4_decontaminate", "op7_quality_rules", "op8_substring_dedup", "op10_jaccard_join"):
        got = queries.queries()[name](spark, folder)
        cols = ", ".join(sorted(got.columns))
        want = con.execute(f"SELECT {cols} FROM ({queries.ORACLES[name]}) ORDER BY doc_id").fetchall()
        assert [tuple(r) for r in got.select(*sorted(got.columns)).orderBy("doc_id").collect()] == want, name
