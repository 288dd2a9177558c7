"""The registered queries of the operators: thin calls that derive the digest columns from each operator's own output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf_quality, decontaminate, jaccard, language, packing, quality_rules, repeats, sharding, warc
from .scratch import shared_dir, ship, written

TOPOLOGY = sharding.Topology.balanced(regions=2, racks=2, shards=4)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"), TOPOLOGY, TOPOLOGY.grown())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.train(docs, ~held_out)
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    items = F.coalesce(F.col("_items"), F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        F.col("_n").alias("n_words"),
        decontaminate.n_hit().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(items) > 0).alias("contaminated"),
        F.greatest(F.size("_near"), F.lit(0)).cast("long").alias("n_near"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, index, folder).drop("url", "payload")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieced = written(packing.pieces(_table(spark, sf_dir, "documents"), _tokenizer()), "pieces")
    return packing.pack(pieced)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.judged(_table(spark, sf_dir, "documents"))
    return q.select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", "_q.base_failed", "_q.kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.covered_text(_table(spark, sf_dir, "documents"), repeats.Bytes(50))
    return found.select("doc_id", F.col("_units").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_runs").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.covered_text(_table(spark, sf_dir, "documents"), repeats.Words(13))
    return found.select("doc_id", F.col("_units").alias("n_words"), F.col("_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def op9_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = crf_quality.train(docs, _table(spark, sf_dir, "labels"), ~held_out)
    found = crf_quality.scored(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | {"pipeline": corpus_pipeline.run}


def _base32(sha1_hex: str) -> str:
    """DuckDB SQL for the base32 form of a SHA-1 in hex: 8 x 20 bits, each four letters."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    bits = [f"(('0x' || substr({sha1_hex}, {5 * i + 1}, 5))::INT >> {s} & 31)" for i in range(8) for s in (15, 10, 5, 0)]
    return "concat(" + ", ".join(f"substr({letters}, {b} + 1, 1)" for b in bits) + ")"


#: DuckDB SQL for the words of a text as the contract of op4 has them.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _draws(level: str, names: str, weights: str) -> str:
    """DuckDB SQL for a level of the tree: the place (from 1) of the child with the largest ln(u) / weight, its name first hashed."""
    u = f"(('0x' || substr(md5('{TOPOLOGY.seed}/' || {names}[i] || '/' || k), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE"
    draws = f"list_transform(range(1, len({names}) + 1), lambda i: ln({u}) / {weights}[i])"
    return f"list_position({draws}, list_max({draws})) AS {level}"


def _tree(topology: sharding.Topology) -> dict[str, str]:
    """The names and weights of a topology's levels as SQL lists: of its regions, by region, and by region and rack."""

    def sql(x) -> str:
        return "[" + ", ".join(map(sql, x)) + "]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    racks = [[r for r in g.racks] for g in topology.regions]
    found = {"gn": [g.name for g in topology.regions], "gw": [g.weight for g in topology.regions]}
    found |= {"rn": [[r.name for r in g] for g in racks], "rw": [[r.weight for r in g] for g in racks]}
    found |= {"sn": [[[f"{r.name}s{s.number}" for s in r.shards] for r in g] for g in racks], "sw": [[[s.weight for s in r.shards] for r in g] for g in racks]}
    return {k: sql(v) for k, v in (found | {"num": [[[s.number for s in r.shards] for r in g] for g in racks]}).items()}


def _located(source: str, topology: sharding.Topology, name: str) -> str:
    """DuckDB SQL for the shard of each key ``k`` of a source with an ``id``."""
    lists = ", ".join(f"{v} AS {k}" for k, v in _tree(topology).items())
    g = f"SELECT id, k, z.*, {_draws('g', 'gn', 'gw')} FROM {source}, (SELECT {lists}) z"
    r = f"SELECT *, {_draws('r', 'rn', 'rw')} FROM (SELECT id, k, g, rn[g] AS rn, rw[g] AS rw, sn[g] AS sn, sw[g] AS sw, num[g] AS num FROM ({g}))"
    return f"SELECT id, num[s] AS {name} FROM (SELECT *, {_draws('s', 'sn', 'sw')} FROM (SELECT id, k, sn[r] AS sn, sw[r] AS sw, num[r] AS num FROM ({r})))"


_SPACE = r" \t\n\x0B\f\r"
_RULES = quality_rules.LineRules()
_BOILER = " OR ".join(f"contains(low, '{x}')" for x in quality_rules.BOILERPLATE)

ORACLES = {
    "op1_sharding": f"""WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda c: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, c)) AS tab),
    d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
    c AS (SELECT id, xor(list_reduce(list_transform(range(strlen(t)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM d, tab),
    s AS ({_located('d', TOPOLOGY, 'shard')}), g AS ({_located('d', TOPOLOGY.grown(), 'grown_shard')}),
    j AS (SELECT d.doc_id, strlen(d.t) + 1 AS size, c.crc, s.shard, g.grown_shard, ('0x' || substr(md5('slot/' || d.k), 1, {sharding.BLOCK_DIGITS}))::INT AS block FROM d JOIN c ON d.id = c.id JOIN s ON d.id = s.id JOIN g ON d.id = g.id)
    SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, crc, size) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard FROM j""",
    "op4_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    t AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS ws FROM benchmark),
    v AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: ws[i:i + 9])) AS win FROM t WHERE len(ws) > 0),
    k AS (SELECT row_number() OVER () AS id, item, win, len(win) AS n, array_to_string(win, ' ') AS s FROM v),
    p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
    need AS (SELECT id, item, n, word, count(*) AS times FROM (SELECT id, item, n, unnest(win) AS word FROM k) GROUP BY ALL),
    a AS (SELECT doc_id, z.n, unnest(range(1, len(ws) - z.n + 2)) AS i, unnest(list_transform(range(1, len(ws) - z.n + 2), lambda i: array_to_string(ws[i:i + z.n - 1], ' '))) AS s FROM d JOIN (SELECT DISTINCT n FROM k) z ON len(ws) >= z.n),
    h AS (SELECT a.doc_id, a.i, a.n, k.item FROM a JOIN k ON a.n = k.n AND a.s = k.s),
    hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS j FROM h) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
    o AS (SELECT p.doc_id, need.id, need.item, need.n, p.i, p.word, need.times FROM p JOIN need ON p.word = need.word),
    f AS (SELECT doc_id, id, item, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, id ORDER BY i RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS held FROM o) WHERE held >= n),
    g AS (SELECT f.doc_id, f.item, f.id, f.i, o.word FROM f JOIN o ON f.doc_id = o.doc_id AND f.id = o.id AND o.i BETWEEN f.i AND f.i + f.n + 2 GROUP BY ALL HAVING count(*) >= max(o.times)),
    near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM (SELECT g.doc_id, g.item FROM g JOIN (SELECT id, count(*) AS terms FROM need GROUP BY id) z ON g.id = z.id GROUP BY g.doc_id, g.item, g.id, g.i, z.terms HAVING count(*) = z.terms) GROUP BY doc_id)
    SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
    FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id LEFT JOIN near ON d.doc_id = near.doc_id""",
    "op5_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
    SELECT page_id, payload_bytes, {_base32('h')} AS payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f""",
    "op8_substring_dedup": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
    p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
    n AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda k: array_to_string(ws[k:k + 12], ' '))) AS s FROM w WHERE len(ws) >= 13),
    m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM n),
    c AS (SELECT p.doc_id, p.word, p.i, coalesce(max(m.again::INT) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone FROM p LEFT JOIN m ON p.doc_id = m.doc_id AND p.i = m.i),
    g AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON w.doc_id = g.doc_id""",
    "op10_jaccard_join": r"""WITH RECURSIVE d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
    r AS (SELECT t, min(doc_id) AS rep, count(*) AS copies, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d GROUP BY t),
    s AS (SELECT DISTINCT rep, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM r WHERE len(ws) > 0),
    n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
    p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.rep <> b.rep GROUP BY a.rep, b.rep),
    l AS (SELECT a, b FROM p JOIN n x ON p.a = x.rep JOIN n y ON p.b = y.rep WHERE common >= 0.8 * (x.n + y.n - common)),
    c AS (SELECT rep AS x, rep AS y FROM r UNION SELECT c.x, e.b FROM c JOIN (SELECT a, b FROM l UNION SELECT u.doc_id, r.rep FROM d u JOIN r ON u.t = r.t UNION SELECT r.rep, u.doc_id FROM d u JOIN r ON u.t = r.t) e ON c.y = e.a),
    k AS (SELECT x, min(y) AS class_id FROM c GROUP BY x),
    m AS (SELECT a, sum(copies) AS n_links FROM l JOIN r ON l.b = r.rep GROUP BY a)
    SELECT d.doc_id, min(k.class_id) AS class_id, min(r.rep) AS rep_id, sum(r.copies)::BIGINT AS n_copies, coalesce(sum(m.n_links), 0)::BIGINT AS n_links
    FROM d JOIN r ON d.t = r.t JOIN k ON r.rep = k.x LEFT JOIN m ON r.rep = m.a GROUP BY d.doc_id""",
    "op7_quality_rules": rf"""WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS t FROM documents),
    l AS (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d),
    x AS (SELECT id, line, list_filter(regexp_split_to_array(line, '[{_SPACE}]+'), lambda w: w <> '') AS ws, lower(line) AS low FROM l WHERE regexp_matches(line, '[^{_SPACE}]')),
    y AS (SELECT *, length(array_to_string(ws, '')) AS chars, length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS symbols, len(ws) AS n,
        length(line) - length(replace(line, '!!', '!')) AS shouts, length(line) - length(replace(line, '|', '')) AS bars,
        length(regexp_replace(line, '\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(line, '\P{{Lu}}+', '', 'g')) AS uppers,
        len(list_filter(range(1, len(ws) - {_RULES.max_run} + 2), lambda i: list_unique(ws[i:i + {_RULES.max_run - 1}]) = 1)) > 0 AS stutters FROM x),
    z AS (SELECT *, symbols > chars * {_RULES.max_symbol_share}::DOUBLE OR shouts > n * {_RULES.max_shout_share}::DOUBLE OR bars > n * {_RULES.max_bar_share}::DOUBLE
        OR (n >= {_RULES.min_upper_words} AND uppers > letters * {_RULES.max_upper_share}::DOUBLE) OR stutters OR {_BOILER} AS fails FROM y),
    s AS (SELECT id, sum(chars) AS chars, sum(symbols) AS symbols, count(*) - count(DISTINCT line) AS dups FROM z GROUP BY id),
    g AS (SELECT id, sum(chars) AS remains FROM (SELECT DISTINCT id, line, chars FROM z WHERE NOT fails) GROUP BY id),
    a AS (SELECT id, list_filter(regexp_split_to_array(t, '[{_SPACE}]+'), lambda w: w <> '') AS ws FROM d),
    o AS (SELECT id, i, count(*) OVER (PARTITION BY id, s) > 1 AS again FROM (SELECT id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS s FROM a WHERE len(ws) > 2)),
    r AS (SELECT id, count(DISTINCT i + j) AS repeats FROM (SELECT id, i, unnest(range(3)) AS j FROM o WHERE again) GROUP BY id),
    q AS (SELECT d.doc_id, len(a.ws)::BIGINT AS n_words, coalesce(s.chars, 0)::BIGINT AS word_chars, coalesce(s.symbols, 0)::BIGINT AS n_symbols, coalesce(s.dups, 0)::BIGINT AS n_dup_lines, coalesce(r.repeats, 0)::BIGINT AS n_repeat_words, coalesce(g.remains, 0) AS remains
        FROM d JOIN a ON d.id = a.id LEFT JOIN s ON d.id = s.id LEFT JOIN g ON d.id = g.id LEFT JOIN r ON d.id = r.id),
    b AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND remains >= word_chars * {_RULES.min_kept_share}::DOUBLE AS kept FROM b""",
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the whole result."""
    import corpus_pipeline

    return dict(ORACLES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
