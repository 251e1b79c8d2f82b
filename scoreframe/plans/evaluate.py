"""Evaluation runs: apply scorers to rows, compare judges with known scores, and report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions.names import unused
from scoreframe.functions.scalar import numeric_score
from scoreframe.operators.scorers import Scorer

#: What a failed task counts as when its score is compared.
FAILED = -1.0


def evaluate(df: DataFrame, scorers: list[Scorer], tags: dict[str, str] | None = None) -> DataFrame:
    """All scorers' columns beside the rows, in one pass, with constant tags."""
    scored = reduce(lambda d, s: s.transform(d), scorers, df)
    return reduce(lambda d, t: d.withColumn(t[0], F.lit(t[1])), (tags or {}).items(), scored)


def long_form(scored: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One row per row and scorer: keys, name, score and metadata."""
    [one] = unused(keys, "_s")
    each = scored.select(*keys, F.explode(F.array(*[F.col(n) for n in names])).alias(one))
    return each.select(*keys, f"{one}.name", f"{one}.score", f"{one}.metadata")


def meta_score(score: Column, expected: Column) -> Column:
    """How close a score comes to the known one; a task without a score counts as FAILED."""
    return numeric_score(F.coalesce(score, F.lit(FAILED)), expected)


def dispatch(df: DataFrame, scorers: dict[str, Scorer], by: str) -> DataFrame:
    """Each row scored by the scorer that its column ``by`` names, as column score, in one pass. A row that names none, or
    one that isn't there, has no score, and an error that says so."""
    wide, score = df, F.lit(None).cast("double")
    for name, s in scorers.items():
        if type(s).transform is Scorer.transform:
            value = s.column(df)["score"]
        else:  # it works with columns of its own
            own, mine = unused(wide.columns, f"_own_{s.name}", f"_{s.name}")
            had = s.name in wide.columns
            made = s.transform(wide.withColumnRenamed(s.name, own) if had else wide).withColumn(mine, F.col(f"{s.name}.score")).drop(s.name)
            wide = made.withColumnRenamed(own, s.name) if had else made
            value = F.col(mine)
        score = F.when(F.col(by) == name, value).otherwise(score)
    unknown = F.col(by).isNull() | ~F.col(by).isin(*scorers)
    error = F.when(unknown, F.concat(F.lit("no such scorer: "), F.coalesce(F.col(by), F.lit("none is named"))))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("score", "error")]
    return wide.select(*kept, score.alias("score"), error.alias("error"))


def report(scored: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean and count of scored and of skipped rows, with subtotals (null) over the grouping columns."""
    return scored.rollup(*by).agg(F.avg(score).alias("mean"), F.count(score).alias("scored"), F.sum(F.col(score).isNull().cast("long")).alias("skipped"))


def lowest(scored: DataFrame, by: list[str], order: list[str], k: int, score: str = "score") -> DataFrame:
    """The k lowest-scored rows of each group; ties go by ``order``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).asc_nulls_last(), *order))
    return scored.withColumn("place", place).where(F.col("place") <= k)
