"""The operators against brute force, round trips and defined cases, on small fixtures."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crf_quality, decontaminate, jaccard, language, packing, quality_rules, repeats, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _q string, score int"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in zip(ids, texts)], DOCS)


def prose(seed, n, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


ODD = [None, "", " \n\t ", "one", "a b c", "ÿ é\x0b日本 é", "x " * 3000]


def test_sharding(spark):
    t = sharding.Topology.balanced(2, 2, 4)
    got = sharding.shard(docs(spark, ODD * 60, [None, *range(len(ODD) * 60 - 1)]), t, t.grown()).toPandas()
    assert len(got) == len(ODD) * 60
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) <= {16} and len(moved)
    row = got[got["doc_id"] == 4].iloc[0]
    assert (row["size"], row["text_crc32"]) == (1 + len(ODD[5].encode()), zlib.crc32(ODD[5].encode()))
    heavy = sharding.Topology((sharding.Region("g0", (sharding.Rack("g0r0", (sharding.Shard(0, 3.0), sharding.Shard(1, 1.0))),)),))
    share = spark.range(4000).select(sharding.locate(F.col("id"), heavy).alias("s")).where("s = 0").count() / 4000
    assert abs(share - 0.75) < 0.04
    assert sharding.shard(docs(spark, []), t).count() == 0


def test_quality_rules_base_counts(spark):
    texts = [*ODD, "a b c a b c d\nx\nx\n\n y #1 |", prose(1, 80), "the the the the"]
    got = quality_rules.judged(docs(spark, texts)).select("doc_id", "_q.*").toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        b = (t or "").encode().split()
        win = [tuple(b[k : k + 3]) for k in range(len(b) - 2)]
        hit = {k + j for k, w in enumerate(win) if win.count(w) > 1 for j in range(3)} if len(b) < 500 else set(range(len(b)))
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (len(b), sum(len(w.decode()) for w in b), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert tuple(got.loc[i][["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want, t
        assert got.loc[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert bool(got.loc[8]["kept"]) and not got["kept"].drop(8).any()
    assert quality_rules.judged(docs(spark, [])).count() == 0


def test_quality_rules_lines(spark):
    good = "\n".join(prose(k, 30) + "." for k in range(4))
    texts = [good, good + "\n" + "SHOUT!! AT!! ALL!!", "\n".join(f"{w}*** {w}$$$ z&&&" for w in good.split()[:60]), good + "\nReleased under the MIT License."]
    q = quality_rules.judged(docs(spark, texts)).select("_q.kept", "_q.clean").collect()
    assert [r["kept"] for r in q] == [True, True, False, True] and q[1]["clean"] == good and q[3]["clean"] == good


def test_quality_rules_capitals_and_stutter(spark):
    good = "\n".join(prose(k, 30) + "." for k in range(4))
    bad = ["BUY NOW CHEAP PILLS x", "ACHETEZ ÉTÉ ÀÉÈ DÉJÀ été", "buy buy buy buy buy now and get the best price", "so go\x0bgo  go\tgo on"]
    fine = ["The EU and the UN met", "go go go on go go go", "gogo go go go gone", "ÉTÉ ÉTÉ 12 été été", "NO x"]
    q = quality_rules.judged(docs(spark, [good + "\n" + x for x in bad + fine])).orderBy("doc_id").select("_q.clean").collect()
    assert [r["clean"] for r in q] == [good] * len(bad) + [good + "\n" + x for x in fine]


@pytest.mark.parametrize(("kind", "unit"), [(repeats.Words(13), "words"), (repeats.Bytes(50), "bytes")])
def test_repeats_match_brute_force(spark, kind, unit):
    shared, r = prose(9, 60), random.Random(3)
    texts = [*ODD]
    for k in range(30):
        w = prose(k, 80).split()
        at = r.randrange(60)
        texts.append(" ".join(w[:at] + shared.split()[r.randrange(20) : 30 + r.randrange(30)] + w[at:]))
    texts += [texts[10], texts[10], shared]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    got = repeats.covered_text(docs(spark, texts, ids), kind, piece_bytes=3000, bucket_bytes=3000).toPandas().set_index("doc_id")
    first = {}
    for i, t in sorted(zip(ids, texts)):
        u = (t or "").encode()
        u = u.split() if unit == "words" else u
        c, wins = np.zeros(len(u), bool), [tuple(u[k : k + kind.width]) for k in range(len(u) - kind.width + 1)]
        for k, w in enumerate(wins):
            if first.get(w, i) < i:
                c[k : k + kind.width] = True
        for w in wins:
            first.setdefault(w, i)
        kept = b" ".join(x for x, y in zip(u, c) if not y) if unit == "words" else bytes(x for x, y in zip(u, c) if not y)
        row = got.loc[i]
        assert (row["_units"], row["_removed"], bytes(row["_kept"])) == (len(u), c.sum(), kept), t
    assert repeats.covered_text(docs(spark, []), kind).count() == 0


def test_language(spark):
    a = [prose(k, 60).replace("w", "th") for k in range(40)]
    b = [prose(k, 60).replace("w", "ñó") for k in range(40)]
    both = docs(spark, a).union(docs(spark, b, range(100, 140)).withColumn("lang", F.lit("es")))
    model = language.train(both, F.col("doc_id") % 2 == 0)
    got = language.identify(both.union(docs(spark, [None, "", "123 !"], [200, 201, 202])).drop("score"), model).toPandas()
    assert (got[got.doc_id < 100].lang_pred == "en").all() and (got[(got.doc_id >= 100) & (got.doc_id < 200)].lang_pred == "es").all()
    assert set(got[got.doc_id >= 200].lang_pred) == {"und"} and got.score.between(0, 1).all()
    assert language.train(docs(spark, []), F.lit(True)) is None


def test_language_learns_every_language(spark):
    rows = [(3 * i + j, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i % 7)}" for _ in range(8 + j)), f"l{i:02d}") for i in range(70) for j in range(3 if i < 69 else 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table, F.col("doc_id") % 3 < 2)
    got = language.identify(table, model).collect()
    assert model.langs == [f"l{i:02d}" for i in range(70)] and all(r["lang_pred"] == r["lang"] for r in got)


def test_language_costs_are_the_recursion():
    train = {"a": [b"abracadabra", b"abba"], "b": [b"banana"]}
    model = language.fit(train)
    for lang_at, lang in enumerate(model.langs):
        grams = {}
        for t in train[lang]:
            s = b"\x00\x00\x00" + t
            for i in range(3, len(s)):
                for k in range(4):
                    c = grams.setdefault((k, s[i - k : i]), {})
                    c[s[i]] = c.get(s[i], 0) + 1

        def bits(ctx, sym, k):
            if k < 0:
                return 8.0
            c = grams.get((k, ctx[len(ctx) - k :]))
            if not c:
                return bits(ctx, sym, k - 1)
            total, kinds = sum(c.values()), len(c)
            return -np.log2(c[sym] / (total + kinds)) if sym in c else -np.log2(kinds / (total + kinds)) + bits(ctx, sym, k - 1)

        for t in (b"abra", b"banzai", b"cab"):
            s = b"\x00\x00\x00" + t
            want = sum(bits(s[i - 3 : i], s[i], 3) for i in range(3, len(s)))
            assert model.bits([t])[0, lang_at] == pytest.approx(want, rel=1e-4)


def test_decontaminate(spark):
    item = prose(5, 25)
    w = item.split()
    texts = [*ODD, prose(6, 40) + " " + " ".join(w[3:15]).upper() + "! " + prose(7, 9), "short item", " ".join(w[:9]), " ".join(w[:5] + ["zz"] + w[5:10])]
    items = spark.createDataFrame([(1, item), (2, "Short, item"), (3, None), (10, item)], "item_id int, text string")
    for block in (1 << 20, 40):
        got = decontaminate.find(docs(spark, texts), items, slop=3, block_bytes=block).select("doc_id", "_items", "_near", decontaminate.n_hit().alias("h")).toPandas().set_index("doc_id")
        assert got["h"].tolist() == [0] * len(ODD) + [12, 2, 0, 0]
        assert list(got.loc[7]["_items"]) == ["1", "10"] and list(got.loc[8]["_items"]) == ["2"] and list(got.loc[10]["_near"]) == ["1", "10"]
    assert decontaminate.find(docs(spark, texts), items.limit(0)).where("size(_items) > 0").count() == 0


def test_decontaminate_proximity_in_production(spark, tmp_path):
    from tidemark.llm import queries, stages

    item = [f"v{k}" for k in range(30)]
    worn = [x for k, w in enumerate(item) for x in ([w, "zz"] if k % 8 == 7 else [w])]
    texts = [prose(1, 40), " ".join(worn), " ".join(item), None]
    docs(spark, texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op4_decontaminate(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["n_items"], r["n_near"], r["contaminated"]) for r in got] == [(0, 0, False), (0, 1, False), (1, 1, True), (0, 0, False)]
    left = stages.decontamination_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in left) == [0, 3]


def test_decontaminate_near_is_one_span():
    r = random.Random(2)
    for _ in range(400):
        ids, window, span = [r.randrange(-1, 6) for _ in range(40)], [r.randrange(6) for _ in range(4)], r.randrange(4, 8)
        want = any(all(ids[a : a + span].count(t) >= window.count(t) for t in window) for a in range(len(ids)))
        assert bool(len(decontaminate.Postings(np.array(ids, np.int32), 6).near(window, span))) == want


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(5, "u5", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u3", None), (9, "a\r\nb", ""), (7, "u7", "x" * 100000), (2, "u2", "<p>é</p>")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages, folder)
    got = {(r["page_id"], r["url"]): r for r in warc.read(spark, index, folder).collect()}
    assert len(got) == 6 and got[5, "u5"]["record_type"] == "revisit" and got[5, "u5"]["refers_to"] == 2 and got[5, "u5"]["payload_bytes"] == 9
    assert got[2, None]["record_type"] == got[2, "u2"]["record_type"] == "response" and got[9, "a%0D%0Ab"]["refers_to"] == 3
    assert bytes(got[7, "u7"]["payload"]) == b"x" * 100000
    assert list(warc.ranges([(0, 5), (5, 5), (20, 3)])) == [(0, 2, 0, 10), (2, 3, 20, 23)]
    empty = warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read(spark, empty, f"file://{tmp_path}/e").count() == 0


def test_packing(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [*ODD, *(prose(k, 40 * k) for k in range(1, 30)), "<|endoftext|> don't　x"]
    pieced = packing.pieces(docs(spark, texts), path, capacity=256).cache()
    got = packing.pack(pieced, capacity=256).toPandas()
    for i, g in got.groupby("doc_id"):
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        g = g.sort_values("piece")
        assert g["length"].sum() == len(ids) and (g["length"].iloc[:-1] == 256).all() and g["start"].tolist() == list(range(0, len(ids), 256))
        assert [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(g["start"], g["length"])] == g["ids_crc32"].tolist()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 256) + 1


def test_word_ids_are_the_tokenizers():
    from array import array

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), packing.WordIds(path)
    texts = ["", "It's a's'sx 'RE're'v 12.5%.. we'll.' 'd 's.", "<|endoftext|>. <|EndOfText|> abc<|endoftext|>!", "é'S É. x\u0301. \u0130!, \u212aK. l'été?! x². a_b_ '' \x1c. e\u0301,", "erbleon.&&& thear,%%% <|startoftext|>.,", *(t or "" for t in ODD)]
    for text in [*texts, " ".join(texts)]:
        assert own(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()


def test_local_search_empties_bins():
    lengths = [6, 6, 5, 5, 4, 4, 3, 3, 2, 2]
    start = [[i] for i in range(len(lengths))]
    out = packing.local_search([list(b) for b in start], lengths, 10)
    assert len(out) == 4 and sorted(i for b in out for i in b) == list(range(10)) and all(sum(lengths[i] for i in b) <= 10 for b in out)


def test_crf_marginals_match_enumeration():
    rng, trans = np.random.default_rng(1), np.array([[0.5, -0.2], [-0.4, 0.9]])
    unary, doc = rng.normal(size=7), np.array([0, 0, 0, 0, 2, 3, 3])
    got, expected = crf_quality.marginals(unary, doc, trans)
    want, want_t = np.zeros(7), np.zeros((2, 2))
    for d in set(doc):
        at = np.flatnonzero(doc == d)
        states = [[(s >> k) & 1 for k in range(len(at))] for s in range(2 ** len(at))]
        w = np.array([np.exp(sum(unary[i] * (y - 0.5) for i, y in zip(at, ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:]))) for ys in states])
        for ys, p in zip(states, w / w.sum()):
            want[at] += p * np.array(ys)
            for a, b in zip(ys, ys[1:]):
                want_t[a, b] += p
    assert np.allclose(got, want) and np.allclose(expected, want_t)


def test_crf_held_out(spark):
    good = ["\n".join(prose(k * 7 + j, 12) + "." for j in range(5)) for k in range(40)]
    bad = ["\n".join(" ".join(f"{w}*** " for w in prose(k * 5 + j, 12).split()) for j in range(5)) for k in range(40)]
    table = docs(spark, [*good, *bad, *ODD])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    got = crf_quality.scored(table.drop("score"), crf_quality.train(table, labels, F.col("doc_id") % 2 == 0)).toPandas().set_index("doc_id")
    assert (got.loc[:39, "score"] > 0.7).all() and (got.loc[40:79, "score"] < 0.3).all() and got["score"].between(0, 1).all()
    assert crf_quality.train(table, labels, F.lit(False)) is None


def test_jaccard_matches_brute_force(spark):
    r, texts = random.Random(5), [*ODD, ""]
    for k in range(12):
        base = prose(k, 120).split()
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = f"n{r.randrange(99)}"
            texts += [" ".join(w)] * r.choice([1, 1, 2])
    got = jaccard.near_duplicates(docs(spark, texts)).toPandas().set_index("doc_id")
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").encode().split()) else frozenset() for t in texts]
    top, n = list(range(len(texts))), [0] * len(texts)

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            same = (texts[a] or "") == (texts[b] or "")
            if same or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
                if not same:
                    n[a] += 1
                    n[b] += 1
    assert got.sort_index()["class_id"].tolist() == [find(a) for a in range(len(texts))]
    assert got.sort_index()["n_links"].tolist() == n
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = ["\n".join(prose(100 * k + j, 25) + "." for j in range(4)) for k in range(12)]
    item = " ".join(prose(999, 20).split())
    texts = [*good, good[0], good[1] + " and more", good[2] + "\n" + item, None, "JUNK!! " * 80]
    table = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept >= {0, 1, *range(3, 12)} and not kept & {12, 13, 15, 16}
