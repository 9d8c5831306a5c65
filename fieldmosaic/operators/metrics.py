"""Scores, rankings and the results document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Classes of a matrix or document at most; more is an error, nothing is left out.
MAX_MATRIX_CLASSES = 10_000


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of right rows, and the test error. A null on either side is never right."""
    right = F.count_if(F.col(label) == F.col(prediction))
    return pred.agg((right / F.count(F.lit(1))).alias("accuracy")).withColumn(
        "test_error", 1 - F.col("accuracy")
    )


def confusion_counts(
    pred: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows per (true, predicted) pair, long form."""
    return pred.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    pred: DataFrame,
    classes: Sequence[str] | None = None,
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """One row per class, true or predicted, one column per predicted class.

    Columns must be known to plan the query, so without ``classes`` the class
    names (not rows) are fetched, and more than ``MAX_MATRIX_CLASSES`` is an error. A
    label or prediction that is not among given ``classes`` stops the job. Pairs with
    a null on one side belong to no cell; ``confusion_counts`` has them.
    """
    pairs = confusion_counts(pred, label, prediction).dropna(subset=[label, prediction])
    if classes is None:
        found = _classes(pairs, label, prediction).limit(MAX_MATRIX_CLASSES + 1).collect()
        if len(found) > MAX_MATRIX_CLASSES:
            raise ValueError("too many classes for a matrix; use confusion_counts")
        classes = sorted(r["class"] for r in found)
    names = list(classes)

    def listed(name: str):
        problem = F.raise_error(F.concat(F.lit(f"{name} is not a listed class: "), F.col(name).cast("string")))
        return F.when(F.col(name).isin(names), F.col(name)).otherwise(problem).alias(name)

    zeros = pred.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("_class"))
    same = F.col("_class").cast(pairs.schema[label].dataType)
    rows = zeros.select(same.alias(label), same.alias(prediction), F.lit(0).cast("bigint").alias("n"))
    known = pairs.select(listed(label), listed(prediction), "n").unionByName(rows)
    return known.groupBy(label).pivot(prediction, names).agg(F.sum("n")).na.fill(0, names)


def _classes(pairs: DataFrame, label: str, prediction: str) -> DataFrame:
    both = F.explode(F.array(label, prediction)).alias("class")
    return pairs.select(both).filter(F.col("class").isNotNull()).distinct()


def precision_recall_fscore_support(
    pred: DataFrame, label: str = "label", prediction: str = "prediction", beta: float = 1.0
) -> DataFrame:
    """Per class of either column: precision, recall, F and support, 0 where undefined.

    One pass over the rows counts pairs; each pair then counts once for its true
    and once for its predicted class.
    """
    n = F.col("n")
    hit = F.when(F.col(label) == F.col(prediction), n).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(label).alias("class"), hit.alias("tp"), n.alias("actual"), zero.alias("predicted")),
        F.struct(F.col(prediction).alias("class"), zero.alias("tp"), zero.alias("actual"), n.alias("predicted")),
    )
    totals = (
        confusion_counts(pred, label, prediction)
        .select(F.inline(sides))
        .filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(*(F.sum(c).alias(c) for c in ("tp", "actual", "predicted")))
    )

    def ratio(top, bottom):
        return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))

    scored = totals.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("predicted")),
            "recall": ratio(F.col("tp"), F.col("actual")),
        }
    )
    b2 = beta * beta
    p, r = F.col("precision"), F.col("recall")
    return scored.select(
        "class", "precision", "recall",
        ratio((1 + b2) * p * r, b2 * p + r).alias("fscore"),
        F.col("actual").alias("support"),
    ).orderBy("class")


def rank_candidates(results: DataFrame) -> DataFrame:
    """Grid-search rows with ``position`` from 1 on: best mean score first, equal scores in
    parameter order. The rows are few, one per candidate."""
    return _positions(results, F.desc("mean_test_score"), F.col("params"))


def _positions(rows: DataFrame, *order) -> DataFrame:
    place = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("position", place).orderBy("position")


def best_candidate(results: DataFrame) -> DataFrame:
    return rank_candidates(results).filter("position = 1")


def rank_importance(importance: DataFrame) -> DataFrame:
    """Bands with ``position`` from 1 on, strongest first; one row per band."""
    return _positions(importance, F.desc("importance"), F.col("band"))


def nonzero_importance(importance: DataFrame) -> DataFrame:
    return importance.filter(F.col("importance") != 0)


def results_document(
    importance: DataFrame,
    pred: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Importance pairs and metrics as one row of arrays, classes and bands in order.

    Only per-band and per-class rows reach the arrays, never samples; more than
    ``MAX_MATRIX_CLASSES`` of either is an error.
    """
    spark = pred.sparkSession

    def arranged(df: DataFrame, order, **values):
        rows = F.array_sort(F.collect_list(F.struct(*order, *(v.alias(k) for k, v in values.items()))))
        # one row more than the bound is enough to know, and no larger array is built
        bounded = df.limit(MAX_MATRIX_CLASSES + 1).agg(rows.alias("rows"))
        problem = F.raise_error(F.lit("too many rows for a results document"))
        fits = F.size("rows") <= MAX_MATRIX_CLASSES
        return bounded.select(F.when(fits, F.col("rows")).otherwise(problem).alias("rows")).scalar()

    pairs = arranged(
        importance, (-F.col("importance"), F.col("band")),
        pair=F.struct(F.col("band"), F.col("importance")),
    )
    classes = arranged(
        precision_recall_fscore_support(pred, label, prediction), (F.col("class"),),
        p=F.col("precision"), r=F.col("recall"), f=F.col("fscore"), s=F.col("support"),
    )
    share = accuracy(pred, label, prediction).select("accuracy").scalar()
    return spark.range(1).select(
        pairs.alias("pairs"), classes.alias("classes"), share.alias("accuracy")
    ).select(
        F.transform("pairs", lambda x: x["pair"]).alias("feat_importance"),
        "accuracy",
        F.transform("classes", lambda x: x["p"]).alias("precision"),
        F.transform("classes", lambda x: x["r"]).alias("recall"),
        F.transform("classes", lambda x: x["f"]).alias("fscore"),
        F.transform("classes", lambda x: x["s"]).alias("support"),
    )
