"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate, repetition); lines that fail are removed; a document
is rejected if too little of it is left, or if it fails the base rules on its whole text.

Defined cases: null and empty texts have no words, fail the base rules and keep an empty cleaned text; a line without a
word is neither good nor bad and is dropped from the cleaned text only between removed lines; repeated rows are judged
each by itself; an empty table gives an empty result; other columns pass through, ``_q`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that part words, and those counted as symbols.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of lines that are no prose, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "copyright (c)",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "licensed under the",
    "lorem ipsum",
    "privacy policy",
    "released under the",
    "sign in to",
    "skip to content",
    "spdx-license-identifier",
    "subscribe to our",
    "terms of service",
    "terms of use",
)


@dataclass(frozen=True)
class LineRules:
    """The thresholds. Shares are of a line's characters other than white space, or of its words."""

    max_symbol_share: float = 0.08
    max_upper_share: float = 0.6
    min_upper_words: int = 3
    max_shout_share: float = 0.3
    max_bar_share: float = 0.2
    max_run: int = 4
    min_kept_share: float = 0.7
    min_words: int = 50


def _bare(c: Column) -> Column:
    return F.translate(c, SPACES, "")


def words(text: Column) -> Column:
    """The words of a text: maximal runs of characters other than white space."""
    return F.array_remove(F.split(text, f"[{SPACES}]+", -1), "")


def _bound(c: Column, f) -> Column:
    """f of an expression's value, which is worked out once however often f uses it inside a lambda."""
    return F.element_at(F.transform(F.array(c), f), 1)


def covered_words(ws: Column) -> Column:
    """How many words lie in a window of three words that occurs more than once in the text.

    Windows are compared by a 64-bit hash within one document. If all hashes differ there is nothing to sort; else the
    windows are sorted by hash and those equal to a neighbour are marked: n log n in the words of the text.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def marked(h: Column) -> Column:
        hit = _bound(
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.transform(
                s, lambda x, j: F.when((x["h"] == F.get(s, j + 1)["h"]) | ((j > 0) & (x["h"] == F.get(s, j - 1)["h"])), x["i"])
            ),
        )
        return F.aggregate(
            F.array_sort(F.array_compact(hit)),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(3))).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    none = F.lit(0).cast("long")
    return F.when(F.size(ws) < 4, none).otherwise(
        _bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(marked(h)))
    )


def parsed_lines(text: Column) -> Column:
    """The lines that have a word, in order, each with its words, their characters and its symbols."""

    def parse(line: Column) -> Column:
        symbols = F.char_length(line) - F.char_length(F.translate(line, SYMBOLS, ""))
        return _bound(
            words(line),
            lambda ws: F.struct(
                line.alias("line"),
                ws.alias("words"),
                F.char_length(F.array_join(ws, "")).cast("long").alias("chars"),
                symbols.cast("long").alias("symbols"),
            ),
        )

    return F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACES}]"))), parse)


def _stutters(ws: Column, run: int) -> Column:
    """Whether a word stands ``run`` times in a row. Only a line with so many words more than distinct ones is searched."""
    spare = F.size(ws) - F.size(F.array_distinct(ws))

    def same(i: Column) -> Column:
        out = F.get(ws, i) == F.get(ws, i + 1)
        for k in range(2, run):
            out = out & (F.get(ws, i) == F.get(ws, i + k))
        return out

    return (spare >= run - 1) & F.exists(F.sequence(F.lit(0), F.size(ws) - run), same)


def line_fails(x: Column, rules: LineRules) -> Column:
    """Whether a line of ``parsed_lines`` is to go."""
    line, ws, n, n_words = x["line"], x["words"], x["chars"], F.size(x["words"])

    def judge(lower: Column) -> Column:
        shouts = F.char_length(line) - F.char_length(F.replace(line, F.lit("!!"), F.lit("!")))
        bars = F.char_length(line) - F.char_length(F.replace(line, F.lit("|"), F.lit("")))
        boiler = F.lit(False)
        for phrase in BOILERPLATE:
            boiler = boiler | F.contains(lower, F.lit(phrase))
        punctuation = (x["symbols"] > n * rules.max_symbol_share) | (shouts > n_words * rules.max_shout_share)
        letters = F.char_length(F.regexp_replace(line, r"\P{L}+", ""))
        uppers = F.char_length(F.regexp_replace(line, r"\P{Lu}+", ""))
        shouting = (n_words >= rules.min_upper_words) & (uppers > letters * rules.max_upper_share)
        navigation = bars > n_words * rules.max_bar_share
        return punctuation | navigation | boiler | shouting | _stutters(ws, rules.max_run)

    return _bound(F.lower(line), judge)


def judged(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The input with one struct column ``_q``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean."""
    t, p = F.coalesce(F.col(text), F.lit("")), "_"
    while any(c.startswith(p) for c in docs.columns if c != "_q"):
        p += "_"  # names of its own, whatever the input's are
    good = F.transform(F.filter(F.col(p + "lines"), lambda x: ~line_fails(x, rules)), lambda x: x["line"])

    def total(field: str) -> Column:
        return F.aggregate(F.col(f"{p}lines.{field}"), F.lit(0).cast("long"), lambda a, n: a + n)

    docs = docs.drop("_q")
    df = docs.withColumn(p + "lines", parsed_lines(t))
    df = df.withColumn(p + "w", F.flatten(p + "lines.words"))
    df = df.withColumns(
        {
            p + "n": F.size(p + "w").cast("long"),
            p + "chars": total("chars"),
            p + "symbols": total("symbols"),
            p + "dups": (F.size(p + "lines") - F.size(F.array_distinct(p + "lines.line"))).cast("long"),
            p + "repeats": covered_words(F.col(p + "w")),
            p + "good": F.array_distinct(good),
        }
    )
    base = (F.col(p + "n") < rules.min_words) | (F.lit(100) * F.col(p + "repeats") > F.lit(50) * F.col(p + "n"))
    left = F.char_length(_bare(F.array_join(p + "good", "\n")))
    kept = ~base & (left >= F.col(p + "chars") * rules.min_kept_share)
    q = F.struct(
        F.col(p + "n").alias("n_words"),
        F.col(p + "chars").alias("word_chars"),
        F.col(p + "symbols").alias("n_symbols"),
        F.col(p + "dups").alias("n_dup_lines"),
        F.col(p + "repeats").alias("n_repeat_words"),
        base.alias("base_failed"),
        kept.alias("kept"),
        F.array_join(p + "good", "\n").alias("clean"),
    )
    # a generated column: a filter on it stays above, and does not copy what it needs into each lambda
    return df.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array(q)).alias("_q"))
