"""Text quality scores of tasks and solutions as native expressions."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.fixed_values import (
    ASCII_PUNCTUATION, BLANK, COMPARISON_OPERATORS, CONCLUSION_OPENINGS, LOGIC_WORDS,
    MATH_OPERATORS, STOP_WORDS, TRANSITIONS,
)
from textloom.functions.prompts import extract_code_blocks
from textloom.functions.text import blank_words, count_substring, jaccard, let, strip_blanks


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _count_all(text: Column, needles: Sequence[str]) -> Column:
    return _sum([count_substring(text, needle) for needle in needles])


def _capped(count: Column, full: float) -> Column:
    return F.least(F.lit(1.0), count / F.lit(full))


def _literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def complexity_score(task: Column) -> Column:
    """Weighted mix of length, vocabulary, long words, numbers, operators and code.

    Operators overlap: ``<=`` also counts as ``<`` and ``=``. The floor is 0.1; a text
    without words scores 0.
    """
    return let(blank_words(F.lower(task)), lambda words: _complexity(task, words))


def _complexity(task: Column, words: Column) -> Column:
    n = F.size(words)
    long_words = F.size(F.filter(words, lambda w: F.length(w) > 8))
    logic = F.size(F.filter(words, lambda w: w.isin(*LOGIC_WORDS)))
    numbers = F.regexp_count(task, F.lit(r"(?U)\b\d+\.?\d*\b"))
    comparisons = _count_all(task, COMPARISON_OPERATORS)
    maths = _count_all(task, MATH_OPERATORS)
    code = F.size(extract_code_blocks(task))
    distinct_share = F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1))
    score = (
        _capped(n, 150.0) * 0.15
        + F.least(F.lit(1.0), distinct_share * 1.5) * 0.20
        + _capped(long_words, 10.0) * 0.15
        + _capped(numbers, 8.0) * 0.15
        + _capped(logic + comparisons, 10.0) * 0.20
        + _capped(maths, 8.0) * 0.10
        + F.least(F.lit(1.0), code * 0.5) * 0.05
    )
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.1), score))


def syllables(word: Column) -> Column:
    """Vowel runs, less a final e, plus a final "le" after a consonant; at least 1."""
    def count(lower: Column) -> Column:
        silent_e = F.when(F.endswith(lower, F.lit("e")), 1).otherwise(0)
        voiced_le = F.when(lower.rlike(r"(?s)[^aeiouy]le\z"), 1).otherwise(0)
        return F.greatest(F.lit(1), F.regexp_count(lower, F.lit("[aeiouy]+")) - silent_e + voiced_le)

    return let(F.lower(word), count)


def clarity_score(task: Column) -> Column:
    """Reading ease scaled to 0..1, mixed with whether a question is asked."""
    pieces = F.split(task, "[.!?]+")
    sentences = F.size(F.filter(pieces, lambda s: F.length(strip_blanks(s)) > 3))
    bare = F.transform(blank_words(task), lambda w: F.btrim(w, F.lit(ASCII_PUNCTUATION)))
    question = F.when(F.contains(task, F.lit("?")), 1.0).otherwise(0.7)

    def score(words: Column, sentences: Column) -> Column:
        n = F.size(words)
        syllable_sum = F.aggregate(words, F.lit(0), lambda total, w: total + syllables(w))
        ease = (
            F.lit(206.835)
            - 1.015 * (n / F.greatest(sentences, F.lit(1)))
            - 84.6 * (syllable_sum / F.greatest(n, F.lit(1)))
        )
        scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ease / 100.0))
        return F.when((n < 5) | (sentences < 1), 0.0).otherwise(scaled * 0.85 + question * 0.15)

    return let(F.array_remove(bare, ""), lambda w: let(sentences, lambda s: score(w, s)))


def content_words(text: Column) -> Column:
    """Distinct lower-case words that are not stop words."""
    return F.array_except(blank_words(F.lower(text)), _literal_array(STOP_WORDS))


def coherence_score(solution: Column) -> Column:
    """Linking phrases and shared content words of neighbouring sentences; may exceed 1."""
    sentences = F.filter(
        F.transform(F.split(solution, "[.!?]+"), strip_blanks),
        lambda s: F.size(blank_words(s)) > 3,
    )
    links = let(F.lower(solution), lambda lower: _count_all(lower, TRANSITIONS))
    return let(sentences, lambda s: F.when(F.size(s) <= 1, 0.3).otherwise(_coherence(s, links)))


def _coherence(sentences: Column, links: Column) -> Column:
    n = F.size(sentences)
    link_share = F.least(F.lit(1.0), links / F.greatest(n * 0.25, F.lit(0.25)))
    sets = F.transform(sentences, content_words)
    # One pass over the sentence sets, remembering the previous one.
    start = F.struct(
        F.lit(None).cast("array<string>").alias("last"), F.lit(0.0).alias("total"),
        F.lit(0).alias("pairs"),
    )

    def step(state: Column, words: Column) -> Column:
        usable = (F.size(state["last"]) > 0) & (F.size(words) > 0)
        overlap = F.when(usable, jaccard(state["last"], words))
        return let(overlap, lambda o: F.struct(
            words.alias("last"), (state["total"] + F.coalesce(o, F.lit(0.0))).alias("total"),
            (state["pairs"] + F.when(o.isNotNull(), 1).otherwise(0)).alias("pairs"),
        ))

    mean = F.aggregate(
        sets, start, step,
        lambda s: F.when(s["pairs"] > 0, s["total"] / F.greatest(s["pairs"], F.lit(1))).otherwise(0.0),
    )
    return F.lit(0.2) + link_share * 0.4 + mean * 0.6


def relevance_score(task: Column, solution: Column) -> Column:
    """Shared content words of task and solution; .5 when the task has none."""
    return let(content_words(task), lambda asked: F.when(F.size(asked) == 0, 0.5).otherwise(
        F.least(F.lit(1.0), F.lit(0.2) + jaccard(asked, content_words(solution)) * 2.0)
    ))


def structure_score(raw_generation: Column) -> Column:
    """Share of numbered, bulleted and concluding lines."""
    return let(F.split(raw_generation, "\n"), lambda lines: F.when(
        F.size(lines) <= 1, 0.2
    ).otherwise(let(F.filter(lines, lambda s: strip_blanks(s) != ""), _structure)))


def _structure(filled: Column) -> Column:
    numbered = F.size(F.filter(filled, lambda s: s.rlike(rf"^{BLANK}*\d+[.)]")))
    bullets = F.size(F.filter(filled, lambda s: s.rlike(rf"^{BLANK}*[-*•]")))
    concluding = F.size(F.filter(filled, lambda s: reduce(
        lambda a, b: a | b,
        [F.startswith(strip_blanks(F.lower(s)), F.lit(opening)) for opening in CONCLUSION_OPENINGS],
    )))
    ratio = F.try_divide(numbered + bullets + concluding * 2, F.size(filled) * 0.5)
    return F.lit(0.2) + F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0))) * 0.8
