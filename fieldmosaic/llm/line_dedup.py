"""Removal of repeated passages by overlapping windows of three lines.

A document's lines are its text cut at ``\\n``. Every three consecutive lines of which one
has a word are a window. Windows are compared over the whole corpus by 128 bits of their
lines; of windows that come more than once, all but the first in order of ``doc_id`` and
line are covered, and lines under any covered window go. Each removed line stands at an
earlier place of the order too, so no content is lost.

A null text has no lines and stays null. Documents of one or two lines have no window and
stay as they are, and so do documents without repeats, byte for byte; a document whose
lines all go has an empty text. Null document ids come first. Different texts under one
``doc_id`` are different documents, in the order of a hash of their texts; equal rows are one
document and come back alike. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmosaic.llm.common import fresh
from fieldmosaic.llm.native import let

LINES = 3
_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``place`` (document id, 31 bits of the text's hash and line as one number in order),
    ``of`` (the text's hash), ``h1``, ``h2``: one row per window."""
    places = let(
        _lines(text),
        lambda lines: F.filter(
            F.transform(
                F.when(F.size(lines) >= LINES, F.sequence(F.lit(0), F.size(lines) - LINES)),
                lambda i: let(
                    F.slice(lines, i + 1, LINES),
                    lambda w: F.when(
                        F.array_join(w, "").rlike(_WORD),
                        F.struct(i.alias("line"), F.xxhash64(w).alias("h1"), F.xxhash64(F.lit("second"), w).alias("h2")),
                    ),
                ),
            ),
            lambda w: w.isNotNull(),
        ),
    )
    found = docs.select(_doc_key().cast("decimal(19,0)").alias("doc"), F.xxhash64(text).alias("of"), F.explode(places).alias("w"))
    low = F.shiftleft(F.col("of").bitwiseAND((1 << 31) - 1), 31) + F.col("w.line")
    return found.select(
        (F.col("doc") * F.lit(1 << 62).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast("decimal(38,0)").alias("place"),
        "of",
        "w.h1",
        "w.h2",
    )


def covered(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_key``, ``of``, ``starts``: the first lines of a document's covered windows.

    Copies of a window merge before the shuffle. The join with the places that stay is a
    sort-merge join, in which adaptive execution splits a window with very many places.
    """
    every = windows(docs, text)
    first = every.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = every.join(first, ["h1", "h2"]).where(F.col("place") > F.col("first"))
    base = F.lit(1 << 62).cast("decimal(19,0)")
    low = F.pmod("place", base)
    doc = ((F.col("place") - low) / base).cast("decimal(19,0)").cast("long")
    return (
        later.select(doc.alias("doc_key"), "of", low.cast("long").bitwiseAND((1 << 31) - 1).cast("int").alias("line"))
        .groupBy("doc_key", "of")
        .agg(F.collect_set("line").alias("starts"))
    )


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without repeated lines, and ``n_lines`` and ``n_removed`` in front of no
    other change; columns of these names are replaced."""
    own_key, own_hash, own_starts, own_kept = fresh(docs, "_doc_key", "_of", "_starts", "_kept")
    found = covered(docs.select("doc_id", F.col(f"`{text}`")), text).toDF(own_key, own_hash, own_starts)
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")])
    marked = plain.withColumns({own_key: _doc_key(), own_hash: F.xxhash64(text)}).join(found, [own_key, own_hash], "left")
    lines = _lines(text)
    kept = let(
        lines,
        lambda every: let(
            F.array_except(
                F.sequence(F.lit(0), F.size(every) - 1),
                F.flatten(F.transform(own_starts, lambda s: F.sequence(s, s + (LINES - 1)))),
            ),
            lambda at: F.struct(F.array_join(F.transform(at, lambda i: F.get(every, i)), "\n").alias("text"), F.size(at).alias("n")),
        ),
    )
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    out = marked.withColumn(own_kept, F.when(F.col(own_starts).isNotNull() & F.col(text).isNotNull(), kept))
    return (
        out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long"))
        .withColumn("n_removed", F.coalesce(F.col("n_lines") - F.col(f"{own_kept}.n"), F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col(own_kept).isNull(), F.col(text)).otherwise(F.col(f"{own_kept}.text")))
        .select(*[F.col(f"`{c}`") for c in plain.columns], "n_lines", "n_removed")
    )


SQL = """
WITH lines AS (
  SELECT doc_id, r.i - 1 AS line, r.l AS l
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i) r
  WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, line, l AS a, lead(l) OVER d AS b, lead(l, 2) OVER d AS c FROM lines
  WINDOW d AS (PARTITION BY doc_id ORDER BY line)),
good AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, line) AS k FROM w
  WHERE c IS NOT NULL AND regexp_matches(a || b || c, '[^\\x20\\x09-\\x0D]')),
gone AS (SELECT DISTINCT doc_id, line + o AS line FROM good, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
         coalesce(string_agg(l.l, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS t
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(t) AS text_md5
FROM documents d LEFT JOIN kept USING (doc_id)
"""
