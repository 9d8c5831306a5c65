import pytest
from conftest import optimized, plan_of
from pyspark.sql import functions as F

from fieldmosaic.functions.codes import EXCLUDED_TYPE_CODES
from fieldmosaic.operators import clean
from fieldmosaic.sources import samples, sinks


@pytest.fixture()
def csv(tmp_path):
    def write(text):
        path = tmp_path / "samples.csv"
        path.write_text(text)
        return str(path)

    return write


def test_missing_tokens_keep_a_column_numeric(spark, csv):
    path = csv(",a,b\n0,1.5,x\n1,,y\n2,NaN,z\n3,NA,w\n")
    for df in (samples.read_samples(spark, path, infer=True), samples.read_samples(spark, path, types={"b": "string"})):
        assert dict(df.dtypes) == {"a": "double", "b": "string"}
        assert [r.a for r in df.collect()] == [1.5, None, None, None]


def test_inference_tells_integers_from_doubles(spark, csv):
    df = samples.read_samples(spark, csv(",id,g,v,e\n0,10,1.0,2,\n1,,2.5,-3,\n"), infer=True)
    assert dict(df.dtypes) == {"id": "int", "g": "double", "v": "int", "e": "double"}
    assert [tuple(r) for r in df.collect()] == [(10, 1.0, 2, None), (None, 2.5, -3, None)]


def test_default_types_read_float_codes(spark, csv):
    df = samples.read_samples(spark, csv(",id,groupID,B06_p50\n0,1110.0,46000.0,1.25\n"))
    assert dict(df.dtypes) == {"id": "int", "groupID": "double", "B06_p50": "double"}
    assert clean.cast_strata(df, ["groupID"]).first() == (1110, 46000, 1.25)


def test_invalid_numbers_stop_the_job(spark, csv):
    df = samples.read_samples(spark, csv(",id,a\n0,1,2.0\n1,2,oops\n"))
    with pytest.raises(Exception, match="column a is not double: oops"):
        df.collect()


def test_index_is_no_part_of_the_duplicate_key(spark, csv):
    df = samples.read_samples(spark, csv(",id,a\n0,1,2.0\n1,1,2.0\n2,1,\n3,1,NA\n"))
    assert df.transform(clean.drop_duplicate_samples).count() == 2


def test_duplicates_made_by_the_integer_cast_stay(spark):
    df = spark.createDataFrame(
        [(1, 2.7), (1, 2.2), (1, 2.2), (2, -2.7), (3, None), (4, float("nan"))], "id int, a double"
    )
    got = sorted(map(tuple, clean.load_clean(df, integers=True).collect()))
    assert got == [(1, 2), (1, 2), (2, -2)]


def test_null_code_is_not_excluded(spark):
    df = spark.createDataFrame([(0,), (1110,), (None,)], "id int")
    assert {r.id for r in clean.exclude_codes(df).collect()} == {1110, None}


def test_require_band_keeps_other_nulls(spark):
    df = spark.createDataFrame(
        [(1.0, None), (None, 1.0), (float("nan"), 1.0)], "B06_p50 double, B06_sd double"
    )
    assert [tuple(r) for r in clean.require_band(df).collect()] == [(1.0, None)]


def test_preview(spark):
    df = spark.range(100).withColumn("k", -F.col("id"))
    assert clean.preview(df).count() == 5
    assert [r.id for r in clean.preview(df, 3, ["k"]).collect()] == [99, 98, 97]
    assert "TakeOrderedAndProject" in plan_of(clean.preview(df, 3, ["k"]))


def test_sample_table_prunes_strata_and_columns(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(400).select(
        (F.col("id") % 30 * 100).cast("int").alias("id"),
        F.when(F.col("id") < 300, 46000).otherwise(22000).alias("groupID"),
        F.col("id").cast("double").alias("a"),
        F.lit(1.0).alias("b"),
    )
    sinks.write_sample_table(df, path)
    back = spark.read.parquet(path)
    chosen = clean.exclude_codes(clean.filter_stratum(back, [22000]), EXCLUDED_TYPE_CODES).select("a")
    plan = plan_of(chosen)
    assert "PartitionFilters: [isnotnull(groupID" in plan
    assert "PushedFilters: [Or(IsNull(id),Not(In(id" in plan
    assert "ReadSchema: struct<id:int,a:double>" in plan
    assert back.count() == 400 and chosen.count() == 100 - 4 - 3  # codes 0 and 1000


def test_filters_move_below_the_distinct(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.range(50).select(
        F.col("id").cast("int").alias("id"), F.lit(1).alias("groupID"), F.lit(2).alias("zoneID"), F.lit(0.5).alias("a")
    ).write.parquet(path)
    raw = spark.read.parquet(path)
    kept = clean.exclude_codes(clean.filter_stratum(clean.load_clean(raw), [1]))
    plan = optimized(kept)
    assert plan.index("Aggregate") < plan.index("Filter")
    assert plan.count("Filter") == 1
    assert plan_of(kept).count("Exchange") == 1


def test_links(spark):
    html = """<a href="x.tif">x</a> <A class='c' HREF='y%20z.tif'>y</A> <a href=bare.tif>b</a>
    <a href="../">up</a> <a name="here">no target</a> <abbr href="n.tif">n</abbr>
    <!-- <a href="hidden.tif">h</a> --><script>var s = '<a href="script.tif">';</script>
    <a data-href="d.tif" href="a&amp;b.tif">z</a><a
       href="last.tif"/>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page int, html string")
    got = samples.list_links(pages, ".tif", "/root/").orderBy("position").collect()
    assert [r.url for r in got] == [
        "/root/" + n for n in ("x.tif", "y%20z.tif", "bare.tif", "a&b.tif", "last.tif")
    ]
    assert [r.position for r in got] == [0, 1, 2, 4, 5]
    assert {r.page for r in got} == {1}


def test_links_of_a_long_page_are_whole(spark):
    html = "".join(f'<a href="tile_{i}.tif">t</a>\n' for i in range(20_000))
    pages = spark.createDataFrame([(html,)], "html string")
    assert samples.list_links(pages).select("url").distinct().count() == 20_000


def test_references_of_all_names(spark):
    """Every name of HTML, numbers, and what is none, as Python's own decoder reads them."""
    from html import unescape
    from html.entities import html5

    texts = [f"a&{n}b&{n}" for n in html5 if n.endswith(";")]
    texts += ["&#38;#39; &#39; &amp;amp;lt;", "&nosuch; & &; &#; &#x; a&b", "&#x1F600;&#233;x", "", "no reference", "&lt&gt;"[3:]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", samples.decode_references(F.col("t")).alias("d")).collect())
    assert got == {i: unescape(t) for i, t in enumerate(texts)}
    odd = spark.createDataFrame([("&#0; &#xD800; &#9999999; &amp",), (None,)], "t string")
    assert [r.d for r in odd.select(samples.decode_references(F.col("t")).alias("d")).collect()] == ["&#0; &#xD800; &#9999999; &amp", None]
