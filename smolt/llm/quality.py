"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression (no user functions), so the rules run
in the scan's stage with no shuffle, whatever the size of a text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smolt.llm.common import SPACE, fresh

#: Symbols that are counted.
SYMBOLS = "[#*$%&|<>]"

#: Common function words of the supported languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "at", "this", "from"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "dem", "im", "mit", "auf", "von", "für"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "pour", "au", "aux", "par"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "que", "en", "un", "una", "es", "no", "se", "por", "con", "para"],
}


@dataclass(frozen=True)
class Rule:
    """Reject a text whose ``measure`` is below ``low`` or above ``high``,
    if the text has at least ``from_words`` words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The production table. Ratios are per word or per line.
RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("repeated_windows", "repeat_ratio", high=0.5),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("exclamation", "shout_ratio", high=0.3),
    Rule("word_length", "mean_word_chars", low=2.0, high=20.0),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("stop_words", "stop_ratio", low=0.01),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(words: Column) -> Column:
    """Hashes of all 3-word windows with their positions."""
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))))


def _repeats(s: Column) -> Column:
    """Words inside windows that occur twice or more; equal windows are
    neighbours in ``s``, the sorted windows."""
    found = F.filter(F.transform(s, lambda x, i: F.when(
        (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])), lambda p: p.isNotNull())
    return F.coalesce(F.size(F.array_distinct(F.flatten(F.transform(found, lambda p: F.array(p, p + 1, p + 2))))), F.lit(0))


def measured(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with a struct ``out`` of all counts of the text (null: a
    text without words). Words and sorted windows are columns of their own
    below it, so each is evaluated once, in the scan's stage."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    words, windows, lines = fresh(docs, "_words", "_windows", "_lines")
    w, ls = F.col(words), F.col(lines)
    d = (docs.withColumn(words, F.array_remove(F.split(t, f"[{SPACE}]+"), ""))
         .withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
         .withColumn(windows, F.sort_array(_windows(w))))
    # exploding one struct keeps later filters on it from being evaluated in the expressions below
    return d.withColumn(out, F.explode(F.array(F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_shouts"),
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        _repeats(F.col(windows)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"))))).drop(words, windows, lines)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


RATIOS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda m: m["n_words"],
    "repeat_ratio": lambda m: _ratio(m["n_repeat_words"], m["n_words"]),
    "symbol_ratio": lambda m: _ratio(m["n_symbols"], m["n_words"]),
    "shout_ratio": lambda m: _ratio(m["n_shouts"], m["n_words"]),
    "mean_word_chars": lambda m: _ratio(m["word_chars"], m["n_words"]),
    "dup_line_ratio": lambda m: _ratio(m["n_dup_lines"], m["n_lines"]),
    "stop_ratio": lambda m: _ratio(m["n_stop_words"], m["n_words"]),
}


def failed_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a text with measures ``m`` breaks, in table order."""
    checks = []
    for r in rules:
        x = RATIOS[r.measure](m)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < F.lit(r.low))
        if r.high is not None:
            bad = bad | (x > F.lit(r.high))
        checks.append(F.when(bad & (m["n_words"] >= r.from_words), F.lit(r.name)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
                  out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: the measures, ``failed`` (the
    broken rules) and ``kept`` (none is broken).

    A null or empty text has no words, lines or symbols and breaks the
    rules that ask for a least count; a very long one is measured whole. Rows are judged alone: repeated rows
    get equal verdicts, an empty table gives none, and other columns pass
    unchanged (a column named as ``out`` is replaced).
    """
    raw, = fresh(docs, "_measures")
    d = measured(docs, text_col, raw)
    names = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
    verdict = _let(failed_rules(F.col(raw), rules), lambda f: F.struct(
        *[F.col(raw)[n].alias(n) for n in names], f.alias("failed"), (F.size(f) == 0).alias("kept")))
    return d.withColumn(out, verdict).drop(raw)
