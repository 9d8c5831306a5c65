import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from fieldmosaic.operators import weights

COUNTS = [7429, 1921, 4040, 1742, 888, 1265, 794, 2694]
CLASSES = ["0", "1200", "1910", "1920", "4350", "5100", "8100", "9100"]
EXPECTED = [
    0.34952550814376093, 1.3517048412285269, 0.6427289603960396, 1.4905998851894375,
    2.9241272522522523, 2.0526679841897235, 3.270308564231738, 0.963854862657758,
]


@pytest.fixture(scope="module")
def counted(spark):
    table = spark.createDataFrame(list(zip(CLASSES, COUNTS)), "label string, n int")
    return table.select("label", F.explode(F.sequence(F.lit(1), "n")).alias("row"))


def test_balanced_weights_match_the_known_list(counted):
    got = weights.balanced_class_weights(counted).collect()
    assert [r.label for r in got] == CLASSES
    assert [r.weight for r in got] == pytest.approx(EXPECTED, rel=1e-15)
    assert [r.n for r in got] == COUNTS


def test_override_of_one_class(counted):
    got = {r.label: r.weight for r in weights.balanced_class_weights(counted, override={"0": 3.5}).collect()}
    assert got["0"] == 3.5 and got["9100"] == pytest.approx(EXPECTED[-1])


def test_automatic_weights_are_proportional(counted):
    auto = [r.weight for r in weights.auto_class_weights(counted).collect()]
    assert min(auto) == 1.0
    assert [a / b for a, b in zip(auto, EXPECTED)] == pytest.approx([auto[0] / EXPECTED[0]] * 8)


def test_totals_need_no_join_and_one_pass(counted):
    df = weights.balanced_class_weights(counted)
    df.collect()
    plan = plan_of(df)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("max_classes", [100, 2])
def test_attached_weights_keep_every_row(spark, counted, max_classes):
    table = weights.balanced_class_weights(counted)
    got = weights.attach_weights(counted, table, max_classes=max_classes)
    assert got.columns == ["label", "row", "weight"]
    totals = {r.label: (r.n, r.w) for r in got.groupBy("label").agg(F.count("*").alias("n"), F.max("weight").alias("w")).collect()}
    assert totals["8100"][0] == 794
    assert totals["0"] == (7429, pytest.approx(EXPECTED[0]))
    assert ("BroadcastHashJoin" in plan_of(got)) == (max_classes == 100)


def test_a_label_without_a_weight_stops_the_job(spark, counted):
    table = weights.balanced_class_weights(counted)
    with pytest.raises(Exception, match="no weight for label 8100"):
        weights.attach_weights(counted, table.filter("label <> '8100'")).collect()
    with pytest.raises(Exception, match="no weight for label null"):
        weights.attach_weights(counted.withColumn("label", F.lit(None).cast("string")), table).collect()


def test_class_counts_leave_out_missing(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, None, None), (2, 1.0, 1.0), (None, 1.0, 1.0)], "id int, a double, b double")
    assert sorted(map(tuple, weights.class_counts(df).collect())) == [(1, 1, 0), (2, 1, 1)]
