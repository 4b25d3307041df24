"""Quality rules as one Spark projection, without user functions.

A table of rules (name, measure, least, most) is compiled to a verdict over measures of length, symbols, stop words and
lines; all measures are built-in expressions over the words and lines of one row, so there is no shuffle.

Words are runs of anything but ASCII white space. A window of ``WINDOW`` words is known by a 64-bit hash of its
words' 64-bit hashes; two different windows of one text agree by chance with a probability below n * n / 2**64.

Defined results: a null text has no words and fails the base rule; rows are judged one by one; an empty table gives an
empty result; other columns pass through ``measure`` (its own columns replace clashing ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that was for on with as be by this are or an from at he his have not but they you which "
    "der die und des von zu das mit den im für ist nicht auf ein eine "
    "le la de les et un une est en que pour dans pas sur avec au qui ou "
    "el los las del y una por con para se no es lo su"
).split()

#: (rule, measure, least, most); None is no bound.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("words", "n_words", 20, 1_000_000),
    ("word length", "mean_word_chars", 3, 10),
    ("symbols to words", "symbol_ratio", None, 0.1),
    ("stop words to words", "stop_word_ratio", 0.02, None),
    ("repeated lines", "dup_line_ratio", None, 0.5),
    ("bullet lines", "bullet_line_ratio", None, 0.9),
    ("lines that trail off", "ellipsis_line_ratio", None, 0.3),
)

_SPACE = r"[\x20\x09-\x0D]+"


def measure(docs: DataFrame, *, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """``docs`` with the measures of the rule table as columns."""
    stop = sorted({v for w in stop_words or STOP_WORDS for v in (w, w.capitalize())})
    own = docs.columns
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "stop_word_ratio", "mean_word_chars", "symbol_ratio", "dup_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio"]
    keep = [F.col(f"`{c}`") for c in own if c not in made]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = docs.select(*keep, body.alias("_t")).withColumns(
        {
            "_words": F.filter(F.split("_t", _SPACE), lambda w: w != ""),
            "_lines": F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    hashed = split.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    count = F.size("_h") - (WINDOW - 1)
    window = F.transform(F.arrays_zip(*[F.slice("_h", k + 1, count) for k in range(WINDOW)]), lambda s: F.xxhash64(s))
    none = F.array().cast("array<bigint>")
    windows = hashed.withColumn("_w", F.when(F.size("_h") >= WINDOW, window).otherwise(none)).drop("_h")
    pairs = F.array_sort(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    nothing = F.array().cast("array<struct<x:bigint,i:int>>")
    sorted_ = windows.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), pairs).otherwise(nothing)).drop("_w")
    twice = F.filter("_s", lambda e, i: (F.get("_s", i - 1)["x"] == e["x"]) | (F.get("_s", i + 1)["x"] == e["x"]))
    found = sorted_.withColumn("_p", F.array_sort(F.transform(twice, lambda e: e["i"]))).drop("_s")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    n_lines = F.size("_lines").cast("long")
    share = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    counted = found.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered,
            "n_lines": n_lines,
            "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stop))).cast("long"),
            "bullet_line_ratio": share(F.size(F.filter("_lines", lambda s: s.rlike(r"^[\x20\x09]*[-*•]"))), n_lines),
            "ellipsis_line_ratio": share(F.size(F.filter("_lines", lambda s: s.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))), n_lines),
        }
    )
    ratios = {
        "mean_word_chars": share(F.col("word_chars"), F.col("n_words")),
        "stop_word_ratio": share(F.col("n_stop_words"), F.col("n_words")),
        "symbol_ratio": share(F.col("n_symbols"), F.col("n_words")),
        "dup_line_ratio": share(F.col("n_dup_lines"), F.col("n_lines")),
    }
    return counted.withColumns(ratios).select(*keep, *made)


def base_failed() -> Column:
    """The base rule: fewer than 20 words, or more than 30 in 100 words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: tuple[tuple[str, str, float | None, float | None], ...] = RULES) -> Column:
    """Whether all rules of the table hold."""
    out = F.lit(True)
    for _, column, least, most in rules:
        if least is not None:
            out = out & (F.col(column) >= least)
        if most is not None:
            out = out & (F.col(column) <= most)
    return out


def broken(rules: tuple[tuple[str, str, float | None, float | None], ...] = RULES) -> Column:
    """The names of the rules that do not hold."""
    each = [F.when(~verdict((r,)), F.lit(r[0])) for r in rules]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    m = measure(docs.select("doc_id", "text"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept"))


#: DuckDB SQL for ``digest``.
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(0, greatest(len(w) - {WINDOW - 1}, 0))) AS i, w FROM w),
v AS (SELECT doc_id, i, w[i + 1 : i + {WINDOW}] AS v FROM g),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM v) WHERE c > 1),
p AS (SELECT doc_id, CAST(sum(least({WINDOW}, coalesce(i - last, {WINDOW}))) AS BIGINT) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda x: x IN ({", ".join("'" + v + "'" for v in sorted({v for w in STOP_WORDS for v in (w, w.capitalize())}))}))) AS n_stop_words,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullets,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) AS n_ellipses
      FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words BETWEEN 20 AND 1000000 AND word_chars BETWEEN 3 * n_words AND 10 * n_words
       AND 10 * n_symbols <= n_words AND 50 * n_stop_words >= n_words AND 10 * n_dup_lines <= 5 * n_lines
       AND 10 * n_bullets <= 9 * n_lines AND 10 * n_ellipses <= 3 * n_lines AS kept
FROM b
"""
