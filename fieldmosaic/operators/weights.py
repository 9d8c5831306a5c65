"""Class counts and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmosaic.session import broadcast_if_small


def class_counts(df: DataFrame, key: str = "id") -> DataFrame:
    """Per code, how many values each other column has; rows without a code are left out."""
    others = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *(F.count(f"`{c}`").alias(c) for c in others)
    )


def _label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def balanced_class_weights(
    df: DataFrame, label: str = "label", override: dict[str, float] | None = None
) -> DataFrame:
    """``rows / (classes * rows of the class)`` per class, sorted by class.

    The totals are a scalar subquery over the same counts, whose exchange Spark
    reuses; no join and no window gathers the classes in one task.
    """
    counts = _label_counts(df, label)
    totals = counts.agg(
        (F.sum("n").cast("double") / F.count(F.lit(1))).alias("share")
    ).scalar()
    weighted = counts.select(label, "n", (totals / F.col("n")).alias("weight"))
    return _overridden(weighted, label, override)


def auto_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``rows of the largest class / rows of the class``: the trainer's balanced mode."""
    counts = _label_counts(df, label)
    largest = counts.agg(F.max("n").cast("double").alias("largest")).scalar()
    return counts.select(label, "n", (largest / F.col("n")).alias("weight")).orderBy(label)


def _overridden(weights: DataFrame, label: str, override: dict[str, float] | None) -> DataFrame:
    weight = F.col("weight")
    for name, value in (override or {}).items():
        weight = F.when(F.col(label) == name, F.lit(float(value))).otherwise(weight)
    return weights.withColumn("weight", weight).orderBy(label)


def attach_weights(
    df: DataFrame, weights: DataFrame, label: str = "label", max_classes: int = 10_000
) -> DataFrame:
    """One weight per row. The weights are broadcast once their number was checked. A row
    whose label has no weight, null among them, stops the job: it would break a fit."""
    side = broadcast_if_small(weights.select(label, "weight"), max_classes)
    text = F.coalesce(F.col(label).cast("string"), F.lit("null"))
    problem = F.raise_error(F.concat(F.lit("no weight for label "), text)).cast("double")
    return df.join(side, label, "left").select(*df.columns, F.coalesce("weight", problem).alias("weight"))
