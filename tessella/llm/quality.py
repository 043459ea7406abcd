"""Quality rules, line first: judge each line, remove the failing ones, then reject documents that lose too much.

A line with a word fails if one of these holds (lines without a word neither fail nor count):

* punctuation: at most SHORT characters and no terminal punctuation at its end;
* navigation: at least SEPARATORS separators `|`;
* symbols: more than one character in SYMBOL_SHARE of `[#*$%&|<>]`;
* shouting: SHOUT characters or more and over half of them A-Z;
* boilerplate: at most SHORT characters and one of PHRASES;
* repetition: equal to an earlier line of its text.

A document is rejected if it fails the base rules (under 20 words, or over 30 % of its words in repeated
8-word windows) or if failing lines hold more than LOST percent of its lines' characters.

All columns come from DataFrame functions over the row itself: no shuffle, no Python, linear in the text but for one
sort of a text's windows where some repeat. Windows are compared by 64-bit hashes within their text.

Defined results: null or empty text: no words, so rejected. Repeated rows: one result each. Nulls in other columns
and extra columns pass through clean() unchanged; a null line never arises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import WORD, let, words_of

SHORT, SEPARATORS, SYMBOL_SHARE, SHOUT, LOST = 300, 3, 20, 20, 50
#: Fixed phrases of boilerplate lines, lower case.
PHRASES = ["javascript", "cookie", "all rights reserved", "terms of use", "terms of service", "privacy policy", "licensed under", "released under", "copyright", "permission is hereby granted", "without warranty"]
SYMBOLS = r"[#*$%&|<>]"
TERMINAL = r"""[.!?:;…"'”’»)\]][\x20\x09-\x0D]*$"""


def _only(text: Column, chars: str) -> Column:
    """How many characters of text are in the class."""
    return F.length(F.regexp_replace(text, f"[^{chars[1:-1]}]+", ""))


def has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def line_fails(line: Column) -> Column:
    """Whether a line with words fails by itself."""
    size = F.length(line)
    short = size <= SHORT
    low = F.lower(line)
    phrase = F.lit(False)
    for p in PHRASES:
        phrase = phrase | F.contains(low, F.lit(p))
    return (
        (short & ~F.rlike(line, F.lit(TERMINAL)))
        | (_only(line, "[|]") >= SEPARATORS)
        | (_only(line, SYMBOLS) * SYMBOL_SHARE > size)
        | ((size >= SHOUT) & (_only(line, "[A-Z]") * 2 > size))
        | (short & phrase)
    )


def _repeat_words(words: Column) -> Column:
    """Words that lie in 8-word windows found twice or more."""

    def covered(windows: Column) -> Column:
        def positions(pairs: Column) -> Column:
            h = lambda k: F.get(pairs, k)["h"]
            return F.array_sort(F.transform(F.filter(pairs, lambda x, k: F.coalesce(x["h"] == h(k - 1), F.lit(False)) | F.coalesce(x["h"] == h(k + 1), F.lit(False))), lambda x: x["i"]))

        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(8), p - acc["last"])).alias("n"), p.alias("last"))
        count = let(let(pairs, positions), lambda at: F.aggregate(at, start, step, lambda acc: acc["n"]))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(count)

    windows = lambda wh: F.transform(F.sequence(F.lit(1), F.size(wh) - 7), lambda i: F.xxhash64(F.slice(wh, i, 8)))
    return F.when(F.size(words) < 8, F.lit(0)).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered))


def measures(text: Column) -> Column:
    """A struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars, lost_chars, cleaned."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n")

    def of(words: Column, lines: Column) -> list[Column]:
        good = F.filter(lines, lambda x: ~line_fails(x))
        chars = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
        return [
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            chars(lines).cast("long").alias("line_chars"),
            let(F.array_distinct(good), lambda kept: F.struct(chars(kept).cast("long").alias("chars"), F.array_join(kept, "\n").alias("text"))).alias("kept"),
        ]

    return let(words_of(text), lambda ws: let(F.filter(lines, has_word), lambda ls: F.struct(_only(text, SYMBOLS).cast("long").alias("n_symbols"), *of(ws, ls))))


def judge(docs: DataFrame, text_col: str = "text", prefix: str = "q_") -> DataFrame:
    """docs with the measures, base_failed, keep and cleaned text, all under the prefix."""
    m = docs.withColumn(f"{prefix}m", measures(F.col(text_col)))
    g = lambda k: F.col(f"{prefix}m")[k]
    base = (g("n_words") < 20) | (100 * g("n_repeat_words") > 30 * g("n_words"))
    out = {k: g(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    out |= {"base_failed": base, "lost_chars": g("line_chars") - g("kept")["chars"], "cleaned": g("kept")["text"]}
    out["keep"] = ~base & (100 * (g("line_chars") - g("kept")["chars"]) <= LOST * g("line_chars"))
    return m.withColumns({prefix + k: c for k, c in out.items()}).drop(f"{prefix}m")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their failing lines removed; the same columns."""
    from_text = judge(docs, text_col, "__q_").where("__q_keep")
    return from_text.withColumn(text_col, F.when(F.col("__q_lost_chars") == 0, F.col(text_col)).otherwise(F.col("__q_cleaned"))).select(*docs.columns)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    j = judge(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return j.select("doc_id", *[F.col(f"q_{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.col("q_keep").alias("kept"), F.col("q_lost_chars").alias("lost_chars"))


def _sql_only(line: str, chars: str) -> str:
    return f"length(regexp_replace({line}, '[^{chars}]+', '', 'g'))"


_PHRASE = " OR ".join(f"contains(lower(x), '{p}')" for p in PHRASES)
_TERMINAL = TERMINAL.replace("'", "''")
_FAILS = f"""((length(x) <= {SHORT} AND NOT regexp_matches(x, '{_TERMINAL}')) OR {_sql_only("x", "|")} >= {SEPARATORS} OR {_sql_only("x", "#*$%&|<>")} * {SYMBOL_SHARE} > length(x)
 OR (length(x) >= {SHOUT} AND {_sql_only("x", "A-Z")} * 2 > length(x)) OR (length(x) <= {SHORT} AND ({_PHRASE})))"""
#: Selects doc_id, text, the counts and verdict from a relation {docs}.
JUDGED = f"""
WITH d AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {{docs}}),
w AS (SELECT rid, t, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + unnest(range(0, 8)) AS k FROM hit) GROUP BY rid),
ln AS (SELECT rid, x, i FROM (SELECT rid, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM w)),
one AS (SELECT rid, x, count(*) AS c, min(i) AS i, any_value(NOT {_FAILS}) AS ok FROM ln GROUP BY rid, x),
lc AS (SELECT rid, sum(c * length(x)) AS line_chars, coalesce(sum(length(x)) FILTER (ok), 0) AS kept_chars, sum(c - 1) AS dup, string_agg(x, chr(10) ORDER BY i) FILTER (ok) AS cleaned FROM one GROUP BY rid),
m AS (SELECT d.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {_sql_only("d.t", "#*$%&|<>")}::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
 coalesce(line_chars, 0)::BIGINT AS line_chars, (coalesce(line_chars, 0) - coalesce(kept_chars, 0))::BIGINT AS lost_chars, cleaned FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lc USING (rid)),
j AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND 100 * lost_chars <= {LOST} * line_chars) AS kept FROM j"""
ORACLE = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars FROM ({JUDGED.format(docs='documents')})"
