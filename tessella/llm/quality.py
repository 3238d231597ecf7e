"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Measures are native columns; each row of ``RULES`` bounds a ratio of two of
them. A document is kept if no bound is crossed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import word_array

WINDOW = 8

#: Frequent short words of the languages that the corpus is meant to hold.
STOP_WORDS = (
    "the of and to in is it that for on with as was by be are this from at or an not "
    "le la les de des du et un une dans que qui en sur pour par au est "
    "der die das den und ein eine ist nicht von mit zu im dem sich auf es "
    "el los las una y del con se lo su no si"
).split()


@dataclass(frozen=True)
class Rule:
    """``least <= numerator / denominator <= most`` for documents of at least ``from_words`` words."""

    name: str
    numerator: str
    denominator: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0

    def broken(self) -> Column:
        value, over = F.col(self.numerator), F.col(self.denominator)
        # products instead of quotients: no division by zero, and a document without words breaks nothing here
        tests = []
        if self.least is not None:
            tests.append(value < over * self.least)
        if self.most is not None:
            tests.append(value > over * self.most)
        out = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        return (F.col("n_words") >= self.from_words) & out


RULES: tuple[Rule, ...] = (
    Rule("word length", "word_chars", "n_words", least=2.0, most=15.0),
    Rule("symbols to words", "n_symbols", "n_words", most=0.10),
    Rule("exclamation marks to words", "n_exclaims", "n_words", most=0.30),
    Rule("stop words to words", "n_stop_words", "n_words", least=0.02, from_words=100),
    Rule("repeated lines to lines", "n_dup_lines", "n_lines", most=0.50),
)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` reads it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""

    def starts(s: Column) -> Column:
        def place(e: Column, k: Column) -> Column:
            twin = (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
            return F.when(twin, e["i"])

        return F.filter(F.transform(s, place), lambda i: i.isNotNull())

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.sort_array(_bind(pairs, starts))
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    return F.aggregate(
        repeated, zero,
        lambda a, i: F.struct((a["words"] + i + WINDOW - F.greatest(i, a["end"])).alias("words"), (i + WINDOW).alias("end")),
        lambda a: a["words"].cast("long"),
    )


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Add the measures of every whole text to ``docs``.

    Two windows count as equal if the 64-bit hashes of their eight words are.
    Columns of ``docs`` with the name of a measure are replaced.
    """
    names = [c for c in docs.columns if c not in MEASURES]
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda line: F.length(F.trim(F.translate(line, "\t\x0b\x0c\r", "    "))) > 0
    cut = docs.select(*names, word_array(text).alias("__words"), F.filter(F.split(text, "\n"), has_word).alias("__lines"), text.alias("__text"))
    n = F.size("__words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))
    stop = F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))
    counted = cut.select(
        *names,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("__text", "[ \\t\\n\\x0B\\f\\r]+", "")).cast("long").alias("word_chars"),
        _without(F.col("__text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        _without(F.col("__text"), "!").cast("long").alias("n_exclaims"),
        F.size(stop).cast("long").alias("n_stop_words"),
        windows.alias("__windows"),
    )
    repeats = F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), _covered(F.col("__windows")))
    return counted.withColumn("n_repeat_words", F.coalesce(repeats, F.lit(0).cast("long"))).drop("__windows")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_exclaims", "n_stop_words", "n_repeat_words")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text_col: str = "text") -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept`` to ``docs``, one row for each input row.

    The base fails with fewer than 20 words, or with more than 30 of 100 words
    in repeated windows. A null or empty text has no words, so its base fails.
    Null ids and repeated rows stay as they are.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & ~rule.broken()
    measured = measure(docs.drop("base_failed", "kept"), text_col=text_col)
    return measured.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    tagged = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__whole"))
    # the row number keeps the optimizer from moving the filter below the measures, where each use would compute them again
    judged = judge(tagged, rules, text_col="__whole").withColumn("__n", F.monotonically_increasing_id())
    return judged.where("kept AND __n >= 0").select("__row.*")


def verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, base measures and verdict of every document."""
    slim = docs.select(F.col(id_col), F.col(text_col).alias("__doc"))
    judged = judge(slim, text_col="__doc")
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def verdicts_sql() -> str:
    """DuckDB SQL for the rows of ``verdicts`` over ``documents``."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    broken = []
    for r in RULES:
        tests = [f"{r.numerator} < {r.denominator} * {r.least}"] if r.least is not None else []
        tests += [f"{r.numerator} > {r.denominator} * {r.most}"] if r.most is not None else []
        broken.append(f"(n_words >= {r.from_words} AND ({' OR '.join(tests)}))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT k, i, words[i : i + {WINDOW - 1}] AS win FROM w, LATERAL (SELECT unnest(range(1, len(words) - {WINDOW - 2})) AS i)),
again AS (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM win),
hit AS (SELECT DISTINCT k, i + o AS at FROM again, LATERAL (SELECT unnest(range(0, {WINDOW})) AS o) WHERE n > 1),
rep AS (SELECT k, count(*) AS n FROM hit GROUP BY k),
m AS (SELECT w.k, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(t) - length(replace(t, '!', '')) AS n_exclaims,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
  coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON w.k = rep.k),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {" OR ".join(broken)} AS broken FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT broken AS kept FROM b"""
