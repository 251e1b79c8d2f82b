"""Scorers as objects: each turns columns of a DataFrame into a score column.

``column(df)`` builds the score from df's columns, ``transform(df)`` adds it by the scorer's name, and ``partial(**options)``
gives a scorer with other options; options at the call win. ``on_error="raise"`` fails the job where a required value is
missing, the default skips the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.functions import editing, jsons, lists, scalar
from scoreframe.functions.names import unused
from scoreframe.functions.score import as_score, required
from scoreframe.plans.judge import JudgeSpec

TEMPLATES = Path(__file__).parent.parent / "templates"


@dataclass(frozen=True)
class Scorer:
    """The base of all scorers: names of the columns, and what to do where one is missing."""

    output: str = "output"
    expected: str = "expected"
    on_error: str = "null"

    @property
    def name(self) -> str:
        return type(self).__name__

    def value(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def metadata(self, df: DataFrame) -> dict[str, Column]:
        return {}

    def needs(self) -> tuple[str, ...]:
        return (self.output, self.expected)

    def column(self, df: DataFrame) -> Column:
        """The score struct."""
        ok = required(self.name, *self.needs(), on_error=self.on_error)
        return as_score(self.name, F.when(ok, self.value(df)), self.metadata(df), self.on_error)

    def transform(self, df: DataFrame, **options) -> DataFrame:
        scorer = replace(self, **options) if options else self
        return df.withColumn(scorer.name, scorer.column(df))

    @classmethod
    def partial(cls, **options) -> Callable[..., Scorer]:
        """A constructor with options of its own; later ones win."""
        return lambda **later: cls(**{**options, **later})


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.select(name).schema[0].dataType


@dataclass(frozen=True)
class Levenshtein(Scorer):
    """Edit similarity of two texts. ``long_texts`` gives the same by a method whose cost grows more slowly with length."""

    long_texts: bool = False

    def value(self, df):
        if self.long_texts:
            return editing.long_levenshtein_score(F.col(self.output), F.col(self.expected))
        return scalar.levenshtein_score(F.col(self.output), F.col(self.expected))


LevenshteinScorer = Levenshtein


class NumericDiff(Scorer):
    """Relative closeness of two numbers."""

    def value(self, df):
        return scalar.numeric_score(F.col(self.output), F.col(self.expected))


class ExactMatch(Scorer):
    """Equality of two values of any type; objects keep the order of their keys."""

    def needs(self):
        return ()

    def value(self, df):
        return jsons.exact(F.col(self.output), F.col(self.expected), (_kind(df, self.output), _kind(df, self.expected)))


class ExactJSON(Scorer):
    """Equality of two JSON texts, white space aside."""

    @property
    def name(self) -> str:
        return "ExactMatch"

    def needs(self):
        return ()

    def value(self, df):
        return jsons.exact_json(F.col(self.output), F.col(self.expected))


@dataclass(frozen=True)
class JSONDiff(Scorer):
    """Structural similarity of JSON texts or of values of any types."""

    string_scorer: jsons.Leaf = jsons.edit_similarity
    number_scorer: jsons.Leaf = jsons.number_similarity
    preserve_strings: bool = False

    def needs(self):
        return ()

    def value(self, df):
        kinds = (_kind(df, self.output), _kind(df, self.expected))
        return jsons.any_difference(F.col(self.output), F.col(self.expected), kinds, self.string_scorer, self.number_scorer, self.preserve_strings)


@dataclass(frozen=True)
class ValidJSON(Scorer):
    """Whether a text, or a value of any other type, is a JSON object or array, or fits a schema."""

    schema: str | dict | None = None
    parsed: bool = False

    def needs(self):
        return ()

    def value(self, df):
        return jsons.valid_value(F.col(self.output), _kind(df, self.output), self.schema, self.parsed)


@dataclass(frozen=True)
class ListContains(Scorer):
    """Overlap of two lists under the best one-to-one assignment."""

    pairwise: lists.Pairwise = scalar.levenshtein_score
    allow_extra_entities: bool = False
    matrix: str = "_matrix"

    def value(self, df):
        return lists.list_score(F.size(self.output), F.size(self.expected), self.allow_extra_entities, self.matrix)

    def metadata(self, df):
        o, e = F.col(self.output), F.col(self.expected)
        return {"pairs": F.transform(lists.best_pairs(self.matrix)["pairs"], lambda p: F.struct(F.get(o, p["o"]).alias("output"), F.get(e, p["e"]).alias("expected"), p["score"].alias("score")))}

    def transform(self, df, **options):
        [matrix] = unused(df.columns, self.matrix)
        scorer = replace(self, **options, matrix=matrix)
        wide = lists.with_matrix(df, F.col(scorer.output), F.col(scorer.expected), scorer.pairwise, matrix)
        return wide.withColumn(scorer.name, scorer.column(wide)).drop(matrix)


@dataclass(frozen=True)
class EmbeddingSimilarity(Scorer):
    """Scaled cosine of two embedding columns."""

    expected_min: float = scalar.EXPECTED_MIN

    def value(self, df):
        return scalar.embedding_score(F.col(self.output), F.col(self.expected), self.expected_min)


@dataclass(frozen=True)
class Moderation(Scorer):
    """1 unless a moderation result (columns flagged and category_scores) is flagged or over the threshold."""

    flagged: str = "flagged"
    category_scores: str = "category_scores"
    threshold: float | None = None

    def needs(self):
        return ()

    def value(self, df):
        return scalar.moderation_score(F.col(self.flagged), F.col(self.category_scores), self.threshold)

    def metadata(self, df):
        return {"threshold": F.lit(self.threshold).cast("double"), "category_scores": F.col(self.category_scores)}


@dataclass(frozen=True)
class CustomScorer(Scorer):
    """A scorer from a function of the output and expected columns."""

    function: Callable[[Column, Column], Column] | None = None
    label: str = "Custom"

    @property
    def name(self) -> str:
        return self.label

    def value(self, df):
        return self.function(F.col(self.output), F.col(self.expected))


def python_scorer(name: str, function: Callable[[object, object], float | None], **options) -> CustomScorer:
    """A scorer from a Python function of two values, sent in Arrow batches; for what no expression can say."""
    @F.pandas_udf("double")
    def run(output: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series([function(o, e) for o, e in zip(output, expected, strict=True)], dtype="float64")

    return CustomScorer(function=run, label=name, **options)


def judge(name: str, **options) -> JudgeSpec:
    """One of the judges that come with a template file."""
    return JudgeSpec.from_file(name, TEMPLATES / f"{_file_of(name)}.yaml", **options)


def _file_of(name: str) -> str:
    return "".join(("_" if i and c.isupper() else "") + c.lower() for i, c in enumerate(name))


JUDGES = ("Battle", "ClosedQA", "Factuality", "Humor", "Possible", "Security", "Sql", "Summary", "Translation")
#: Group, scorer, columns beside output and expected.
REGISTRY = (
    *[("LLM-as-a-Judge", j, x) for j, x in zip(JUDGES, ("instructions", "input,criteria", "input", "", "input", "", "input", "input", "input,language"), strict=True)],
    ("LLM-as-a-Judge", "Moderation", "flagged,category_scores"),
    *[("RAG", n, "input,context") for n in ("ContextEntityRecall", "ContextRelevancy", "ContextRecall", "ContextPrecision", "Faithfulness", "AnswerRelevancy", "AnswerCorrectness")],
    ("RAG", "AnswerSimilarity", ""),
    ("Composite", "ListContains", ""), ("Composite", "ValidJSON", "schema"),
    ("Embeddings", "EmbeddingSimilarity", ""),
    *[("Heuristic", n, "") for n in ("JSONDiff", "Levenshtein", "ExactMatch", "NumericDiff")],
)


def registry(spark) -> DataFrame:
    """All scorers by group."""
    return spark.createDataFrame(list(REGISTRY), "label string, name string, needs string")
