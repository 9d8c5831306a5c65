import json

import pytest
from conftest import plan_of

from fieldmosaic.operators import metrics
from fieldmosaic.sources import sinks

PAIRS = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")] + [("b", "d")]


@pytest.fixture(scope="module")
def pred(spark):
    return spark.createDataFrame(PAIRS, "label string, prediction string")


def brute_force():
    out = {}
    for name in sorted({x for pair in PAIRS for x in pair}):
        tp = sum(t == p == name for t, p in PAIRS)
        actual = sum(t == name for t, _ in PAIRS)
        guessed = sum(p == name for _, p in PAIRS)
        precision = tp / guessed if guessed else 0.0
        recall = tp / actual if actual else 0.0
        f = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        out[name] = (precision, recall, f, actual)
    return out


def test_accuracy(pred):
    assert tuple(metrics.accuracy(pred).first()) == pytest.approx((8 / 12, 4 / 12))


def test_a_null_is_never_right(spark):
    df = spark.createDataFrame([("a", "a"), (None, None), ("a", None)], "label string, prediction string")
    assert metrics.accuracy(df).first().accuracy == pytest.approx(1 / 3)
    (a,) = metrics.precision_recall_fscore_support(df).collect()
    assert (a.precision, a.recall, a.support) == (1.0, 0.5, 2)


def test_scores_per_class_of_either_side(pred):
    got = metrics.precision_recall_fscore_support(pred).collect()
    assert [r["class"] for r in got] == ["a", "b", "c", "d"]
    for r in got:
        assert tuple(r)[1:] == pytest.approx(brute_force()[r["class"]])
    assert sum(r.support for r in got) == len(PAIRS)


def test_beta(pred):
    got = {r["class"]: r for r in metrics.precision_recall_fscore_support(pred, beta=2.0).collect()}
    p, r, _, _ = brute_force()["a"]
    assert got["a"].fscore == pytest.approx(5 * p * r / (4 * p + r))


def test_confusion(pred):
    long = {(r.label, r.prediction): r.n for r in metrics.confusion_counts(pred).collect()}
    assert long == {("a", "a"): 5, ("a", "b"): 2, ("b", "b"): 3, ("c", "a"): 1, ("b", "d"): 1}
    wide = {r.label: r.asDict() for r in metrics.confusion_matrix(pred).collect()}
    assert wide["a"] == {"label": "a", "a": 5, "b": 2, "c": 0, "d": 0}
    assert wide["d"] == {"label": "d", "a": 0, "b": 0, "c": 0, "d": 0}  # only ever predicted
    with pytest.raises(Exception, match="prediction is not a listed class: d"):
        metrics.confusion_matrix(pred, ["a", "b", "c"]).collect()
    for r in metrics.precision_recall_fscore_support(pred).collect():
        row = wide[r["class"]]
        assert sum(v for k, v in row.items() if k != "label") == r.support


def test_scores_read_the_rows_once(pred):
    plan = plan_of(metrics.precision_recall_fscore_support(pred))
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan


def test_ranking(spark):
    rows = [("x", 0.5), ("b", 0.9), ("a", 0.9), ("z", 0.0)]
    table = spark.createDataFrame(rows, "params string, mean_test_score double")
    assert [r.params for r in metrics.rank_candidates(table).collect()] == ["a", "b", "x", "z"]
    assert [r.position for r in metrics.rank_candidates(table).collect()] == [1, 2, 3, 4]
    assert metrics.best_candidate(table).collect()[0].params == "a"
    bands = spark.createDataFrame(rows, "band string, importance double")
    kept = metrics.nonzero_importance(metrics.rank_importance(bands)).collect()
    assert [r.band for r in kept] == ["a", "b", "x"]


def test_results_document(spark, pred, tmp_path):
    bands = spark.createDataFrame([("u", 0.1), ("v", 0.7), ("w", 0.0)], "band string, importance double")
    path = str(tmp_path / "results")
    sinks.write_results(metrics.results_document(bands, pred), path)
    (line,) = spark.read.text(path).collect()
    got = json.loads(line.value)
    expected = brute_force()
    assert [p["band"] for p in got["feat_importance"]] == ["v", "u", "w"]
    assert got["accuracy"] == pytest.approx(8 / 12)
    for i, field in enumerate(("precision", "recall", "fscore", "support")):
        assert got[field] == pytest.approx([expected[c][i] for c in sorted(expected)])
