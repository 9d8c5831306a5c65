"""Choose parameters by cross-validation, refit, score held-out rows and report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmosaic.operators.learn import grid_search, importance_table, predict
from fieldmosaic.operators.metrics import rank_candidates, results_document
from fieldmosaic.operators.splits import split_hash, stratified_folds
from fieldmosaic.sources.sinks import save_model, write_results


@dataclass(frozen=True)
class Selection:
    candidates: DataFrame  # params, mean and standard deviation of the score, best first
    model: PipelineModel
    predictions: DataFrame  # held-out rows with prediction columns
    results: DataFrame  # the one-row results document


def select_model(
    samples: DataFrame,
    bands: Sequence[str],
    grid: Mapping[str, Sequence],
    key: str,
    path: str | None = None,
    k: int = 3,
    test_share: float = 0.3,
    label: str = "label",
    **params,
) -> Selection:
    """Hold out a stable share, search the grid on stratified folds of the rest.

    ``key`` names a unique text column. With ``path`` the model and the results
    document are saved below it.
    """
    rows = split_hash(samples, key, test_share)
    train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
    folded = stratified_folds(train.select(key, *(f"`{b}`" for b in bands), label), key, label, k)
    table, model = grid_search(folded, bands, grid, k=k, label=label, **params)
    predictions = predict(model, test)
    results = results_document(
        importance_table(model, samples, percent=True), predictions, label, "predicted_label"
    )
    if path is not None:
        save_model(model, f"{path}/model")
        write_results(results, f"{path}/results")
    return Selection(rank_candidates(table), model, predictions, results)
