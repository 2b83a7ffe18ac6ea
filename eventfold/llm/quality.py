"""Operator 6: quality rules, a threshold table compiled into one projection.

Each rule is a row (name, measure, least, most). ``verdict`` turns the table
into one Boolean column over the measures; measures and verdict are built-in
Spark expressions in one narrow projection, without user functions, shuffle
or broadcast.

Repeated three-word windows are found in two steps. A document all of whose
windows have different hashes repeats none. Only the others sort their windows
as text, so hash collisions cannot change a count. No step compares each
window with each other one, so long texts stay near linear.

Rows: null text has no word, so it fails the base rule; an empty line or one
of white space only is no line; any id, also a null or repeated one, is passed
through; one output row per input row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import id_text

#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was be with as this by at are from or an not",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como",
}
#: (rule, measure, least, most); a bound of None is open.
RULES = [
    ("mean_word_chars", "word_chars / greatest(n_words, 1)", 1.5, 20.0),
    ("symbols_per_word", "n_symbols / greatest(n_words, 1)", None, 0.4),
    ("stop_word_ratio", "n_stop_words / greatest(n_words, 1)", 0.02, None),
    ("dup_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
]
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also if ``use`` reads it in a loop."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first included."""
    last = F.size(words) - 3

    def window(f: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), last), f)

    def covered(rows: Column) -> Column:
        again = F.filter(rows, lambda r, j: ((j > 0) & (F.get(rows, j - 1)["t"] == r["t"]))
                         | F.coalesce(F.get(rows, j + 1)["t"] == r["t"], F.lit(False)))
        starts = F.sort_array(F.transform(again, lambda r: r["i"]))
        zero = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(
            i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")), lambda a: a["n"])

    exact = F.sort_array(window(lambda i: F.struct(
        F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("t"), i.alias("i"))))
    hashes = window(lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last < 1, F.lit(0)).when(some, let(exact, covered)).otherwise(F.lit(0)).cast("long")


def verdict(rules: list[tuple[str, str, float | None, float | None]]) -> Column:
    """The table as one Boolean column over the measures."""
    out = F.lit(True)
    for _, measure, least, most in rules:
        value = F.expr(measure)
        if least is not None:
            out = out & (value >= F.lit(least))
        if most is not None:
            out = out & (value <= F.lit(most))
    return F.coalesce(out, F.lit(False))


def quality(docs: DataFrame, rules: list[tuple] | None = None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, kept."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = id_text(docs, id_col, text_col).select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    measured = parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(F.col("words"), repeated_words).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & verdict(RULES if rules is None else rules))


def oracle(rules: list[tuple] | None = None) -> str:
    """The same rows in DuckDB SQL."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    bounds = [f"{m} {op} {v}" for _, m, lo, hi in (RULES if rules is None else rules) for op, v in ((">=", lo), ("<=", hi)) if v is not None]
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
w AS (SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM p),
t AS (SELECT r, i, concat_ws(' ', word, lead(word) OVER v, lead(word, 2) OVER v) AS t, lead(word, 2) OVER v AS third
        FROM w WINDOW v AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM t WHERE third IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words FROM p LEFT JOIN c USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce({' AND '.join(f'({b})' for b in bounds) or 'true'}, false) AS kept FROM m"""
