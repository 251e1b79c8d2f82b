"""The score column: a struct of name, score and metadata (JSON text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE = T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("metadata", T.StringType())])


def as_score(name: str, value: Column, metadata: dict[str, Column] | None = None, on_error: str = "null") -> Column:
    """A score struct. A null value is a skipped score. Values outside 0 to 1, and NaN, fail with ``on_error="raise"`` and
    are skipped otherwise."""
    value = value.cast("double")
    good = (value >= 0) & (value <= 1) & ~F.isnan(value)
    if on_error == "raise":
        value = F.when(value.isNull() | good, value).otherwise(F.raise_error(F.concat(F.lit(f"{name}: score outside 0 to 1: "), value.cast("string"))).cast("double"))
    else:
        value = F.when(good, value)
    kept = F.to_json(F.struct(*[c.alias(k) for k, c in metadata.items()])) if metadata else F.lit("{}")
    return F.struct(F.lit(name).alias("name"), value.alias("score"), kept.alias("metadata"))


def as_json(score: Column) -> Column:
    """A score struct as JSON text, with the score named also where it is null."""
    return F.to_json(score, {"ignoreNullFields": "false"})


def required(name: str, *columns: str, on_error: str = "null") -> Column:
    """True where all columns have values; with ``on_error="raise"`` a missing one fails the job."""
    ok = F.lit(True)
    for c in columns:
        if on_error == "raise":
            ok = ok & F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{name}: {c} is required")).cast("boolean")).otherwise(F.lit(True))
        else:
            ok = ok & F.col(c).isNotNull()
    return ok
