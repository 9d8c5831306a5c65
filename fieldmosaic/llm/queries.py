"""The registered queries on corpora, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmosaic.llm import (
    ball_tree, boosted_quality, byte_bpe, fingerprints, line_dedup, ngram_join, packing, quality_rules, resampling, token_files, toxicity,
    url_lists, zip_warc,
)
from fieldmosaic.llm.common import documents, table
from fieldmosaic.llm.labelled import remainder
from fieldmosaic.session import new_path


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path, tokenizer_file("word_bpe_49k.json"))
    return token_files.digests(spark, path)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def _number(text) -> Column:
    """A number that follows from a text: 32 bits of its md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time, which the tables lack: a time of the year 2024 that
    follows from ``page_id``."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.cast("timestamp").alias("fetch_time"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries, which the tables lack too, over the hosts, domains and first path
    segments of all pages: about a fifth is listed, taken off 40 days later and listed again
    90 days after the first time. The numbers follow from the patterns."""
    host = url_lists.host_of(F.col("url"))
    parts = pages.select(host.alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]+)", 1).alias("first"))
    def entry(name: str, kind: str, pattern: Column) -> Column:
        return F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"))

    segment = F.when(F.col("first") != "", F.concat_ws("/", "host", "first"))
    three = (
        entry("ads", "host", F.col("host")),
        entry("malware", "domain", F.substring_index("host", ".", -3)),
        entry("spam", "prefix", segment),
    )
    named = parts.select(F.explode(F.array(*three)).alias("e"))
    chosen = named.select("e.*").where("pattern IS NOT NULL").distinct().withColumn("n", _number(F.concat("list", "pattern")))
    days = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(d).alias("after")) for a, d in (("add", 0), ("remove", 40), ("add", 90))])
    first = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.floor(F.col("n") / 5), F.lit(300)).cast("int"))
    return chosen.where("n % 5 = 0").select("list", "kind", "pattern", first.alias("first"), F.explode(days).alias("d")).select(
        "list", "kind", "pattern", "d.action", F.date_add("first", F.col("d.after")).alias("day")
    )


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = url_lists.evaluate(captures(pages), list_entries(pages), "page_id")
    return judged.select("page_id", "host", "blocked", "n_matches", "lists", F.col("since").cast("string").alias("since"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).select(
        "doc_id", *quality_rules.BASE, "base_failed", "kept"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, remainder(5) != 0)
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5")
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = boosted_quality.train(docs, labels, remainder(4) != 2)
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return boosted_quality.score(docs, trees).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zip_warc.round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


URL_SQL = """
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 7919) % 366)::INTEGER AS day,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\\.$', ''), '') AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1) AS first
  FROM pages),
named AS (
  SELECT 'ads' AS list, 'host' AS kind, host AS pattern FROM p
  UNION SELECT 'malware', 'domain', array_to_string(string_split(host, '.')[-3:], '.') FROM p
  UNION SELECT 'spam', 'prefix', host || '/' || first FROM p WHERE first <> ''),
chosen AS (
  SELECT *, ('0x' || substr(md5(list || pattern), 1, 8))::BIGINT AS n FROM named WHERE pattern IS NOT NULL),
began AS (SELECT list, kind, pattern, DATE '2024-01-01' + ((n // 5) % 300)::INTEGER AS d FROM chosen WHERE n % 5 = 0),
valid AS (
  SELECT list, kind, pattern, d AS valid_from, d + 40 AS valid_to FROM began
  UNION ALL SELECT list, kind, pattern, d + 90, DATE '9999-01-01' FROM began),
hits AS (
  SELECT page_id, v.* FROM p JOIN valid v ON kind = 'host' AND pattern = host AND day >= valid_from AND day < valid_to
  UNION ALL
  SELECT page_id, v.* FROM p, LATERAL (SELECT unnest(generate_series(1, len(string_split(host, '.')))) AS i) s
  JOIN valid v ON kind = 'domain' AND pattern = array_to_string(string_split(host, '.')[i:], '.') AND day >= valid_from AND day < valid_to
  UNION ALL
  SELECT page_id, v.* FROM p JOIN valid v ON kind = 'prefix' AND first <> '' AND pattern = host || '/' || first AND day >= valid_from AND day < valid_to)
SELECT p.page_id, any_value(host) AS host, CASE WHEN any_value(host) IS NOT NULL THEN count(h.list) > 0 END AS blocked, count(h.list) AS n_matches,
       coalesce(string_agg(DISTINCT h.list, ',' ORDER BY h.list), '') AS lists, CAST(min(valid_from) AS VARCHAR) AS since
FROM p LEFT JOIN hits h ON h.page_id = p.page_id GROUP BY p.page_id
"""

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_url_lists": op2_url_lists,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_packing": op9_packing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_warc": op11_warc,
    "op12_resampling": op12_resampling,
    "op13_ranked_search": op13_ranked_search,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_lists": URL_SQL,
        "op4_quality_rules": quality_rules.SQL,
        "op7_line_dedup": line_dedup.SQL,
        "op11_warc": zip_warc.SQL,
        "op13_ranked_search": ball_tree.SQL,
    }
