"""Class labels as frame operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmosaic.functions.codes import OTHER_CLASS, class_of
from fieldmosaic.session import broadcast_if_small


def with_label(df: DataFrame, classes: Mapping[str, Sequence[int]], out: str = "label") -> DataFrame:
    return df.withColumn(out, class_of(F.col("id"), classes))


def label_from_table(df: DataFrame, mapping: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Label by a ``(id, label)`` table; codes it lacks get the other class.

    Two different labels for one code stop the job, equal ones count once. The
    table is broadcast when it has at most ``max_rows`` codes, else joined by
    shuffle.
    """
    clash = F.raise_error(F.concat(F.lit("two labels for code "), F.col("id").cast("string")))
    unique = (
        mapping.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .select("id", F.when(F.col("low") == F.col("high"), F.col("low"))
                .when(F.col("low").isNotNull(), clash.cast("string")).alias("label"))
    )
    joined = df.join(broadcast_if_small(unique, max_rows), "id", "left")
    return joined.withColumn("label", F.coalesce("label", F.lit(OTHER_CLASS))).select(
        *df.columns, "label"
    )
