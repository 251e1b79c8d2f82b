"""Scores of texts, numbers and vectors as native expressions; each returns a double column, null where it can't be told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarity at and below which two embeddings count as unrelated.
EXPECTED_MIN = 0.7
#: All characters that count as white space around a text.
WHITE = "".join(chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def stripped(text: Column) -> Column:
    """The text without white space around it."""
    return F.btrim(text, F.lit(WHITE))


def levenshtein_score(output: Column, expected: Column) -> Column:
    """One minus the edit distance over the longer length, in code points; two empty texts score 1."""
    o, e = output.cast("string"), expected.cast("string")
    longer = F.greatest(F.length(o), F.length(e))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(o, e) / longer)


def exact_score(output: Column, expected: Column) -> Column:
    """1 where both have the same text, else 0; a missing value reads ``None`` and so equals that word and itself."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return (text(output) == text(expected)).cast("double")


def numeric_score(output: Column, expected: Column) -> Column:
    """One minus the difference over the sum of magnitudes; two zeros score 1."""
    o, e = output.cast("double"), expected.cast("double")
    return F.when((o == 0) & (e == 0), F.lit(1.0)).otherwise(1 - F.try_divide(F.abs(e - o), F.abs(e) + F.abs(o)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, at most 1; 0 where one has no length. The longer vector's rest counts in its norm only."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    shared = F.least(F.size(a), F.size(b))
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).when(norms > 0, F.least(F.lit(1.0), F.try_divide(_dot(F.slice(a, 1, shared), F.slice(b, 1, shared)), norms)))


def scaled(similarity: Column, expected_min: float = EXPECTED_MIN) -> Column:
    """Similarities from expected_min to 1 spread over 0 to 1; below it, 0."""
    if expected_min >= 1:
        raise ValueError("expected_min must be below 1")
    return F.when(similarity.isNotNull(), F.greatest((similarity - expected_min) / (1 - expected_min), F.lit(0.0)))


def embedding_score(a: Column, b: Column, expected_min: float = EXPECTED_MIN) -> Column:
    """Scaled cosine of two embeddings."""
    return scaled(cosine(a, b), expected_min)


def moderation_score(flagged: Column, categories: Column, threshold: float | None = None) -> Column:
    """0 where a moderation result is flagged or, with a threshold, where any category exceeds it; else 1."""
    if threshold is None:
        return F.when(flagged, 0.0).when(~flagged, 1.0)
    return F.when(F.exists(F.map_values(categories), lambda v: v > threshold), F.lit(0.0)).when(categories.isNotNull(), F.lit(1.0))


def choice_score(choice: Column, scores: dict[str, float], on_error: str = "null") -> Column:
    """The score of a judge's choice, white space around it ignored; an unknown choice is null or fails the job."""
    table = F.create_map(*[F.lit(x) for pair in scores.items() for x in (pair[0], float(pair[1]))])
    found = F.element_at(table, stripped(choice))
    if on_error == "raise":
        return F.when(choice.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("unknown choice "), choice)).cast("double")).otherwise(found)
    return found


def f1_score(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from counts of true positives, false positives and false negatives; null where all are 0."""
    return F.try_divide(tp, tp + 0.5 * (fp + fn))


def sum_of(array: Column) -> Column:
    """The sum of an array of numbers as a double; null entries count 0."""
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def mean_of(array: Column) -> Column:
    """The mean of an array of numbers; null where it is empty."""
    return F.try_divide(sum_of(array), F.size(array))


def clamp(value: Column) -> Column:
    """The value held to 0 to 1; null stays null."""
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))
