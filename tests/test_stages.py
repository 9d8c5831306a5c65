import glob
import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from fieldmosaic.plans import stages
from fieldmosaic.session import broadcast_if_small, new_path, shared_dir
from fieldmosaic.sources import sinks
from fieldmosaic.sources.store import Folder, VersionedTable

from conftest import ROOT


@pytest.fixture()
def source(spark):
    return spark.range(3000).select(
        F.col("id").alias("seq"),
        F.concat(F.lit("EPSG: 3263"), (F.col("id") % 3).cast("string")).alias("srs"),
        (F.col("id") % 40 + 30).alias("px"),
        (F.floor(F.col("id") / 60) + 400).alias("py"),
        (F.col("id") * 0.5).alias("value"),
    )


def plan():
    return stages.mosaic_stages(10_000, 10_000, (4, 8))


def rows(df):
    return sorted(map(tuple, df.select("level", "bx", "by", "value").collect()))


def folder(base, stage, part=None):
    """The folder of a stage, or of a part in its newest attempt."""
    (found,) = [f for f in os.listdir(base) if f.startswith(f"{stage}-")]
    if part is None:
        return os.path.join(base, found)
    return max(glob.glob(os.path.join(base, found, "attempt-*", part)), key=os.path.getmtime)


ALL = ["index", "zones", "zone_mosaics", "reprojected", "combined"]
ZONES = ["EPSG32630", "EPSG32631", "EPSG32632"]


def test_resume_starts_where_tables_are_whole(source, tmp_path):
    base = str(tmp_path)
    table, ran = stages.run_stages(source, plan(), base)
    expected = rows(table)
    assert list(ran) == ALL and ran["zones"] == ZONES and expected
    assert stages.run_stages(source, plan(), base)[1] == {}
    shutil.rmtree(folder(base, "combined"))
    table, ran = stages.run_stages(source, plan(), base)
    assert ran == {"combined": []} and rows(table) == expected
    # A finished last stage is enough, whatever became of the others.
    shutil.rmtree(folder(base, "zone_mosaics"))
    assert stages.run_stages(source, plan(), base)[1] == {}


def test_a_lost_zone_alone_is_made_again(source, tmp_path):
    base = str(tmp_path)
    expected = rows(stages.run_stages(source, plan(), base)[0])
    kept = {f: os.path.getmtime(folder(base, "reprojected", f)) for f in ("zone=EPSG32630", "zone=EPSG32632")}
    shutil.rmtree(folder(base, "combined"))
    shutil.rmtree(folder(base, "reprojected", "zone=EPSG32631"))
    table, ran = stages.run_stages(source, plan(), base)
    assert ran == {"reprojected": ["EPSG32631"], "combined": []} and rows(table) == expected
    assert kept == {f: os.path.getmtime(folder(base, "reprojected", f)) for f in kept}
    # Lost in an earlier stage too, it is made from the furthest table that has it.
    for stage in ("combined", "reprojected/zone=EPSG32631", "zone_mosaics/zone=EPSG32631"):
        name, _, part = stage.partition("/")
        shutil.rmtree(folder(base, name, part or None))
    table, ran = stages.run_stages(source, plan(), base)
    assert ran == {"zone_mosaics": ["EPSG32631"], "reprojected": ["EPSG32631"], "combined": []} and rows(table) == expected


def test_overwrite_makes_a_stage_anew(source, tmp_path):
    base = str(tmp_path)
    expected = rows(stages.run_stages(source, plan(), base)[0])
    table, ran = stages.run_stages(source, plan(), base, overwrite=["reprojected", "combined"])
    assert ran == {"reprojected": ZONES, "combined": []} and rows(table) == expected


def test_damaged_tables_are_not_complete(source, tmp_path):
    base = str(tmp_path)
    expected = rows(stages.run_stages(source, plan(), base)[0])
    level = folder(base, "combined", "level=4")
    part = next(f for f in os.listdir(level) if f.endswith(".parquet"))
    with open(f"{level}/{part}", "r+b") as f:
        f.truncate(10)
    os.remove(f"{level}/.{part}.crc")
    damaged = stages.run_stages(source, plan(), base)
    # The table is made as a whole, so all of it is made again when any part is damaged.
    assert damaged[1] == {"combined": []} and rows(damaged[0]) == expected


def test_other_tiles_or_settings_start_anew(source, tmp_path):
    base = str(tmp_path)
    first = rows(stages.run_stages(source, plan(), base)[0])
    changed = source.withColumn("value", F.when(F.col("seq") == 7, 99.0).otherwise(F.col("value")))
    table, ran = stages.run_stages(changed, plan(), base)
    assert list(ran) == ALL and rows(table) != first
    assert stages.run_stages(source.repartition(5), plan(), base)[1] == {}
    # Other levels change the last table only, another resolution the reprojected one too.
    table, ran = stages.run_stages(source, stages.mosaic_stages(10_000, 10_000, (2,)), base)
    assert ran == {"combined": []} and {r[0] for r in rows(table)} == {1, 2}
    table, ran = stages.run_stages(source, stages.mosaic_stages(10_000, 20_000, (4, 8)), base)
    assert list(ran) == ["reprojected", "combined"] and len(rows(table)) < len(first)
    assert rows(stages.run_stages(source, plan(), base)[0]) == first


def test_fingerprint_sees_copies_and_not_the_order(source, spark, tmp_path):
    assert stages.fingerprint(source) == stages.fingerprint(source.orderBy(F.desc("seq")))
    assert stages.fingerprint(source) != stages.fingerprint(source.unionByName(source.filter("seq < 2")))
    assert stages.fingerprint(source) != stages.fingerprint(source.withColumnRenamed("value", "v"))
    # Files are known by name, size and time: no job runs.
    path = str(tmp_path / "pixels")
    source.write.parquet(path)
    before = stages.fingerprint(spark.read.parquet(path))
    assert before == stages.fingerprint(spark.read.parquet(path))
    assert before != stages.fingerprint(spark.read.parquet(path).filter("seq > 3"))
    source.limit(5).write.mode("append").parquet(path)
    assert before != stages.fingerprint(spark.read.parquet(path))


def test_clean_keeps_the_index_and_the_result(source, tmp_path):
    table, _ = stages.run_stages(source, plan(), str(tmp_path), clean=True)
    assert {f.split("-")[0] for f in os.listdir(tmp_path)} == {"index", "combined"}
    assert rows(table)
    assert stages.run_stages(source, plan(), str(tmp_path))[1] == {}


def test_an_empty_stage_is_an_error(source, tmp_path):
    with pytest.raises(RuntimeError, match="wrote no data"):
        stages.run_stages(source.withColumn("srs", F.lit("")), plan(), str(tmp_path))


def test_index_from_listed_tiles_and_publishing(source, spark, tmp_path):
    tiles = source.select("seq", F.concat(F.lit("t"), "seq").alias("url"), "srs", *(F.lit(0.0).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    links = tiles.filter("srs <> 'EPSG: 32632'").select("url").unionByName(tiles.select("url").limit(1))
    given = {"source": source, "tiles": tiles, "links": links}
    shared = str(tmp_path / "shared")
    table, ran = stages.run_stages(given, plan(), str(tmp_path / "run"), publish=shared)
    assert ran["zone_mosaics"] == ["EPSG32630", "EPSG32631"]
    published = sinks.read_published(spark, f"{shared}/zone_mosaics")
    assert {r.zone for r in published.select("zone").distinct().collect()} == {"EPSG32630", "EPSG32631"}
    assert rows(sinks.read_published(spark, f"{shared}/combined", "level")) == rows(table)


def zone_counts(df):
    return {r.zone: r["count"] for r in df.groupBy("zone").count().collect()}


def test_publishing_replaces_only_delivered_zones(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).select(F.concat(F.lit("z"), (F.col("id") % 4).cast("string")).alias("zone"), "id")
    sinks.publish_partitions(df, path)
    sinks.publish_partitions(df.filter("zone = 'z1'").limit(3), path)
    assert zone_counts(sinks.read_published(spark, path)) == {"z0": 25, "z1": 3, "z2": 25, "z3": 25}


def test_readers_see_a_delivery_whole_or_not(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, path)
    df = spark.range(100).select(F.concat(F.lit("z"), (F.col("id") % 4).cast("string")).alias("zone"), "id")
    sinks.publish_partitions(df, path)
    before = sinks.read_published(spark, path)
    torn = df.withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id") + 1000))
    with pytest.raises(Exception, match="lost"):
        sinks.publish_partitions(torn, path)
    assert zone_counts(sinks.read_published(spark, path)) == {f"z{i}": 25 for i in range(4)}
    sinks.publish_partitions(df.filter("zone <> 'z2'").withColumn("id", F.col("id") + 1000), path)
    # who began to read before goes on with what was there
    assert before.agg(F.max("id")).first()[0] == 99
    after = sinks.read_published(spark, path)
    assert after.agg(F.count_if(F.col("id") >= 1000)).first()[0] == 75 and after.count() == 100
    assert not [f for f in os.listdir(f"{path}/manifests") if not f.strip(".").split(".")[0].isdigit()]
    sinks.publish_partitions(df, path)
    table = VersionedTable(spark, path, "zone")
    attempts = {f for f in os.listdir(path) if f.startswith("attempt-")}
    table.sweep()
    assert {f for f in os.listdir(path) if f.startswith("attempt-")} < attempts and table.read().count() == 100


def test_one_writer_takes_a_number(spark, tmp_path):
    file = Folder(spark, str(tmp_path / "m" / "1"))
    assert file.create("first") and not file.create("second") and file.read_text() == "first"
    table = VersionedTable(spark, str(tmp_path / "t"))
    raced = []

    def change(now):
        """Another writer commits between the look and the commit, once."""
        if not raced:
            raced.append(table.commit(lambda parts: {**parts, "b": ("y", 2)}))
        return {**now, "a": ("x", 1)}

    assert table.commit(change) == {"a": ("x", 1), "b": ("y", 2)} == table.parts()
    assert sorted(f for f in os.listdir(tmp_path / "t" / "manifests") if not f.startswith(".")) == ["0000000001", "0000000002"]


JOB = """
import json, sys
sys.path.insert(0, sys.argv[1])
from fieldmosaic.plans import stages
from fieldmosaic.session import local_session
spark = local_session(2, "resumed")
spark.sparkContext.setLogLevel("OFF")
if len(sys.argv) > 4:
    spark.range(5).selectExpr("transform(array(id), x -> x + 1)").collect()  # other numbers for expressions
source = spark.read.parquet(sys.argv[2]).filter("seq >= 0").selectExpr("seq", "srs", "px", "py", "value + size(transform(array(1), v -> v)) AS value")
table, ran = stages.run_stages(source, stages.mosaic_stages(10_000, 10_000, (4, 8)), sys.argv[3])
print("RAN", json.dumps([ran, table.count()]))
"""


def test_a_later_process_goes_on(source, tmp_path):
    """The fingerprint of an input is the same in every process, so a job that was ended is
    resumed by the next one."""
    path, base = str(tmp_path / "pixels x"), str(tmp_path / "run")
    source.write.parquet(path)

    def job(*more):
        done = subprocess.run([sys.executable, "-c", JOB, ROOT, path, base, *more], capture_output=True, text=True, timeout=300)
        return json.loads(done.stdout.split("RAN ")[1])

    ran, n = job()
    assert list(ran) == ALL
    assert job("other") == [{}, n]
    shutil.rmtree(folder(base, "reprojected", "zone=EPSG32631"))
    shutil.rmtree(folder(base, "combined"))
    assert job("other") == [{"reprojected": ["EPSG32631"], "combined": []}, n]


def test_plans_that_files_do_not_tell_go_by_rows(source, spark, tmp_path):
    path = str(tmp_path / "pixels")
    source.write.parquet(path)
    read = spark.read.parquet(path)
    few = spark.createDataFrame([(1,), (2,)], "seq long")
    more = spark.createDataFrame([(1,), (3,)], "seq long")
    assert stages._plan_text(read.join(few, "seq")) is None
    assert stages.fingerprint(read.join(few, "seq")) != stages.fingerprint(read.join(more, "seq"))
    wide = read.select(*((F.col("value") + i).alias(f"v{i}") for i in range(60)))
    other = read.select(*((F.col("value") + i + (1 if i == 50 else 0)).alias(f"v{i}") for i in range(60)))
    assert stages.fingerprint(wide) != stages.fingerprint(other)
    twice = read.select((F.col("px") + F.col("py")).alias("a")), read.select((F.col("px") + F.col("px")).alias("a"))
    assert stages.fingerprint(twice[0]) != stages.fingerprint(twice[1])


@pytest.mark.parametrize("named", [["zones"], ["zone_mosaics"], ["reprojected"], ["index"]])
def test_overwriting_a_stage_remakes_what_reads_it(source, tmp_path, named):
    base = str(tmp_path)
    expected = rows(stages.run_stages(source, plan(), base)[0])
    table, ran = stages.run_stages(source, plan(), base, overwrite=named)
    assert list(ran) == ALL[ALL.index(named[0]) :] and rows(table) == expected
    assert stages.run_stages(source, plan(), base)[1] == {}
    with pytest.raises(ValueError, match="no such stage"):
        stages.run_stages(source, plan(), base, overwrite=["mosaics"])


def test_two_jobs_on_one_base_do_not_mix(source, tmp_path, monkeypatch):
    """A job that finishes a stage while another makes it wins; the other takes its table."""
    base = str(tmp_path)
    real, inside = stages.VersionedTable.write, []

    def write(self, df):
        made = real(self, df)
        if "zone_mosaics" in self.path and not inside:
            inside.append(None)
            inside[0] = stages.run_stages(source, plan(), base)
        return made

    monkeypatch.setattr(stages.VersionedTable, "write", write)
    table, ran = stages.run_stages(source, plan(), base)
    assert ran["zone_mosaics"] == ZONES and rows(table) == rows(inside[0][0])
    (held,) = glob.glob(f"{base}/zone_mosaics-*")
    attempts = {a for a, _ in stages.VersionedTable(source.sparkSession, held, "zone").parts().values()}
    assert len(attempts) == 1 < len(glob.glob(f"{held}/attempt-*"))


def tile_table(spark, given):
    return spark.createDataFrame(given, "seq long, srs string, url string").withColumns({c: F.lit(0.0) for c in ("xmin", "ymin", "xmax", "ymax")})


def test_only_listed_tiles_are_in_the_mosaic(spark, tmp_path):
    a, b = "EPSG: 32631", "EPSG: 32632"
    pixels = spark.createDataFrame([(1, a, 40, 400, 1.0), (2, a, 40, 400, 9.0), (3, b, 40, 400, 5.0), (4, "", 40, 400, 7.0)], "seq long, srs string, px long, py long, value double")
    given = {
        "source": pixels, "tiles": tile_table(spark, [(1, a, "one"), (2, a, "two"), (3, b, "three"), (4, "", "four")]),
        "links": spark.createDataFrame([("one",), ("one",), ("four",)], "url string"),
    }
    table, ran = stages.run_stages(given, plan(), str(tmp_path / "a"))
    assert ran["zones"] == ["EPSG32631"] and {r[3] for r in rows(table)} == {1.0}
    # a zone with pixels that no tile accounts for is no silent loss
    for missing in ([(1, a, "one"), (2, a, "two")], [(1, a, "one"), (2, a, "two"), (3, a, "three")]):
        with pytest.raises(ValueError, match="tile 3 has 1 pixels in EPSG32632"):
            stages.run_stages({**given, "tiles": tile_table(spark, missing)}, plan(), str(tmp_path / "b"))


def test_shared_folder(spark, monkeypatch):
    base = shared_dir(spark)
    assert base == shared_dir(spark) and new_path(spark, "x").startswith(base + "/x-")
    assert new_path(spark, "x") != new_path(spark, "x")

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"
            used = None

            @classmethod
            def getCheckpointDir(cls):
                return cls.used

            @classmethod
            def setCheckpointDir(cls, path):
                cls.used = path

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
    Cluster.conf.get = staticmethod(lambda key, default=None: "hdfs://shared/dir/")
    assert shared_dir(Cluster) == "hdfs://shared/dir"
    assert Cluster.sparkContext.used == "hdfs://shared/dir/"


def test_broadcast_only_what_was_counted(spark):
    small, large = spark.range(5), spark.range(50)
    assert broadcast_if_small(large, 10) is large
    kept = broadcast_if_small(small, 10)
    assert kept.schema == small.schema and kept.count() == 5
    assert "hint" in kept._jdf.queryExecution().logical().toString().lower()
