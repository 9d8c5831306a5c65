"""Sample tables in buckets: cleaned, written and learned from without wide shuffles."""

import os

import pytest
from conftest import plan_of
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fieldmosaic.functions import codes
from fieldmosaic.operators import clean, labels, learn, splits
from fieldmosaic.plans import scenarios
from fieldmosaic.session import CLEANUP, freed_shuffles, shared_dir
from fieldmosaic.sources import sinks

BANDS = ["B06_p50", "VV_p50"]


def sample_rows(spark, n=600):
    """Rows of a few codes that follow from the first band."""
    listed = F.array(*map(F.lit, (1110, 1200, 1510, 4350, 5100)))
    return spark.range(n).select(
        F.get(listed, (F.col("id") % 5).cast("int")).alias("id"),
        F.get(F.array(*map(F.lit, (46000, 22000, 43000, 6000))), (F.col("id") % 4).cast("int")).alias("groupID"),
        (F.col("id") % 7).cast("int").alias("zoneID"),
        (F.col("id") % 5 * 100 + F.col("id") / n).alias("B06_p50"),
        (F.col("id") * 37 % 101).cast("double").alias("VV_p50"),
        F.concat(F.lit("row "), F.col("id").cast("string")).alias("key"),
    )


def written(spark, rows, path, buckets=4):
    sinks.write_bucketed_samples(rows, path, buckets)
    return spark.read.parquet(path)


def shuffle_files(spark) -> set[str]:
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (kept.apply(i).getName() for i in range(kept.size())) if "shuffle" in n}


def test_distinct_by_hash_is_the_distinct(spark):
    df = spark.createDataFrame(
        [(1, 0.0, "a"), (1, -0.0, "a"), (1, 0.0, None), (1, None, "a"), (None, None, None), (None, None, None),
         (2, float("nan"), "b"), (2, float("nan"), "b"), (3, 1.5, "c"), (4, 1.5, "c")],
        "id int, a double, t string",
    )
    want = sorted(map(str, clean.drop_duplicate_samples(df).collect()))
    assert len(want) == 7
    got = clean.drop_duplicate_samples(df, by_hash=True)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == want


def test_rows_that_come_once_are_not_shuffled_whole(spark):
    rows = sample_rows(spark)
    assert "Exchange" in plan_of(clean.load_clean(rows))
    kept = clean.load_clean(rows, by_hash=True)
    assert "Exchange" not in plan_of(kept) and kept.count() == 600


def test_buckets_hold_every_row_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "TURN", 2)
    rows = sample_rows(spark).repartition(3).withColumn("zoneID", F.when(F.col("zoneID") > 0, F.col("zoneID")))
    before = shuffle_files(spark)
    table = written(spark, rows, str(tmp_path / "t"), 5)
    assert not shuffle_files(spark) - before
    back = table.select(*rows.columns)
    assert back.count() == 600 and back.exceptAll(rows).count() == 0
    assert table.where(F.pmod(sinks.PLACE, F.lit(5)) != F.col(sinks.BUCKET)).count() == 0
    assert len(os.listdir(tmp_path / "t" / "groupID=6000")) == 5


def test_bucket_counts_are_powers_of_two():
    assert [sinks.bucket_count(n) for n in (0, 1, 16 << 20, (16 << 20) + 1, 35_000_000)] == [16, 16, 16, 32, 64]


def test_cleanup_is_set_inside_only(spark):
    before = spark.conf.get(CLEANUP)
    with pytest.raises(KeyError), freed_shuffles(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise KeyError
    assert spark.conf.get(CLEANUP) == before


def test_a_model_of_buckets_follows_from_its_rows_alone(spark, tmp_path):
    rows = sample_rows(spark)
    rows = splits.split_hash(labels.with_label(rows, codes.TYPE_CLASSES), "key", out="is_validation")
    scored = []
    for n in (1, 4):
        table = written(spark, rows.repartition(n, "zoneID"), str(tmp_path / str(n)), 8)
        dealt = learn._dealt(table, BANDS, 8)
        assert "Exchange" not in plan_of(dealt)
        assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() == 8
        model = learn.train_classifier(table, BANDS, algorithm="forest", buckets=8, iterations=5, depth=5, seed=1)
        scored.append(learn.predict(model, rows).select("key", "predicted_label", vector_to_array("probability").alias("p")))
    assert scored[0].exceptAll(scored[1]).count() == 0
    other = learn.train_classifier(table, BANDS, algorithm="logistic", buckets=8, maxIter=5)
    assert learn.predict(other, rows).count() == 600


def test_scenarios_read_a_table_in_buckets_in_place(spark, tmp_path):
    table = written(spark, sample_rows(spark), str(tmp_path / "t"))
    chosen = [s for s in scenarios.SCENARIOS if s.name in ("type_full", "type_43000_6000")]
    plain, bands = scenarios.scenario_rows(table.drop(sinks.BUCKET, sinks.PLACE), chosen[0], "key")
    mine, same = scenarios.scenario_rows(table, chosen[0], "key")
    assert bands == same and mine.columns == [*plain.columns, sinks.BUCKET, sinks.PLACE]
    assert mine.select(*plain.columns).exceptAll(plain).count() == 0
    before = set(os.listdir(shared_dir(spark)))
    done = scenarios.train_scenarios(table, chosen, key="key", buckets=4, iterations=5, depth=5, seed=1)
    assert set(os.listdir(shared_dir(spark))) == before  # nothing is written again
    got = {r.scenario: r for r in scenarios.summarise(done).collect()}
    for s in chosen:
        want, _ = scenarios.scenario_rows(table, s, "key")
        assert got[s.name].test_rows == want.where("is_validation").count() > 0
        assert got[s.name].accuracy > 0.9
