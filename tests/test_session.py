"""Session settings that queries are run with."""

from fieldmosaic.session import CODEC, tune


def test_zstd_unless_a_codec_was_chosen(spark):
    plain, chosen = spark.newSession(), spark.newSession()
    chosen.conf.set(CODEC, "snappy")
    assert tune(plain).conf.get(CODEC) == "zstd"
    assert tune(chosen).conf.get(CODEC) == "snappy"


def test_tuned_results_are_written_with_zstd(spark, tmp_path):
    session = tune(spark.newSession())
    session.range(10).write.parquet(f"{tmp_path}/rows")
    assert list(tmp_path.glob("rows/*.zstd.parquet"))
