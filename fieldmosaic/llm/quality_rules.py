"""Quality rules: counts of a document, and its divergence from its language.

Base rules fail documents under ``MIN_WORDS`` words and those with more than 30 % of their
words in repeated windows of eight. Beyond them two histograms of a document are held
against those of its language in the corpus: character classes, and the language's most
common words with all other words as one bin. The measure is the Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1); a document with a larger distance than
the limit is rejected. Histograms of few words say little, so each comparison has a least
number of words, and a language too: documents of a language with less text pass.

References are a table with a row per language, for any number of languages, from every
document that names its language. A document without a language takes the one whose common
words it has most of, ties by name; with none of them, as in a corpus without any language
(all null, or empty), only the base rules decide. A null text has no words and fails. Every
row is judged on its own text, so ties and repeated rows have no effect; extra columns pass
through.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmosaic.llm.common import fresh, written
from fieldmosaic.llm.native import let, words

MIN_WORDS = 20
WINDOW = 8
COMMON = 8
#: Letters of a common word at most.
COMMON_LETTERS = 6
CLASSES = ("lower", "upper", "white", "digit", "symbol", "stop", "other_ascii", "beyond_ascii")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_VOID = r"[^\x20\x09-\x0D]"


@dataclasses.dataclass(frozen=True)
class Limits:
    """Largest distances that stay, and the words of a document and of a language's
    reference from which a comparison is made."""

    classes: float = 0.3
    common: float = 0.25
    class_words: int = 20
    common_words: int = 100
    reference_words: int = 2000


def _without(text: Column, kind: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, kind, ""))


def repeat_words(listed: Column) -> Column:
    """Words inside windows of eight that a text has twice or more."""

    def marked(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            ordered,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when((x.h == F.get(s, k + 1).h) | (x.h == F.get(s, k - 1).h), x.i),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + (WINDOW - 1))))))

    def joined(a: Column, step: int) -> Column:
        """Each element hashed with the one ``step`` places on."""
        return let(
            a, lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - step), F.slice(x, step + 1, F.size(x)), lambda p, q: F.xxhash64(p, q))
        )

    return F.when(
        F.size(listed) > WINDOW,
        let(
            joined(joined(joined(listed, 1), 2), 4),  # two, four, eight words
            lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), marked(hashes)).otherwise(0),
        ),
    ).otherwise(0)


def rest_of(text: Column) -> Column:
    """A text without lower-case letters and white space: what is left to count by class."""
    return F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")


def base_columns(listed: Column, text: Column, rest: Column) -> dict[str, Column]:
    """The counts; ``listed`` are the words of ``text``, which isn't null, ``rest`` its rest."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_VOID))
    columns = {
        "n_words": F.size(listed),
        "word_chars": F.length(F.array_join(listed, "")),
        "n_symbols": _without(rest, r"[#*$%&|<>]+"),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))),
        "n_repeat_words": repeat_words(listed),
    }
    return {k: v.cast("long") for k, v in columns.items()}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def class_counts(text: Column, rest: Column, word_chars: Column) -> Column:
    """Characters by class."""
    return F.array(
        word_chars - F.length(rest),
        _without(rest, "[A-Z]+"),
        F.length(text) - word_chars,
        _without(rest, "[0-9]+"),
        _without(rest, r"[#*$%&|<>!]+"),
        _without(rest, "[.,]+"),
        _without(rest, r"[\x00-\x7F&&[^A-Z0-9#*$%&|<>!.,]]+"),
        _without(rest, r"[^\x00-\x7F]+"),
    ).cast("array<int>")


def common_counts(listed: Column, common: Column) -> Column:
    """Times that a text has each of the common words, and its other words. The words stand
    between two blanks each, so a word is counted by the length that its removal takes away."""

    def counts(x: Column) -> Column:
        found = F.transform(
            x.common,
            lambda w: ((x.n - F.octet_length(F.replace(x.s, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("int"),
        )
        return let(found, lambda f: F.concat(f, F.array(x.size - F.aggregate(f, F.lit(0), lambda a, b: a + b))))

    spaced = F.concat(F.lit(" "), F.array_join(listed, "  "), F.lit(" "))
    own = F.struct(spaced.alias("s"), common.alias("common"), F.size(listed).alias("size"))
    return let(own, lambda y: let(F.struct(y.s.alias("s"), F.octet_length(y.s).alias("n"), y.common.alias("common"), y.size.alias("size")), counts))


def common_words(known: DataFrame) -> DataFrame:
    """The most frequent short words of each language ``of``, ties by the word: a list of
    at most ``COMMON`` words and how often each stands in the texts ``t``."""
    listed = known.select("of", F.explode(words(F.col("t"))).alias("w")).where(F.length("w") <= COMMON_LETTERS)
    counted = listed.groupBy("of", "w").agg(F.count("*").alias("n")).where(F.col("w").rlike(r"^\pL+$"))
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("n"), "w"))
    best = counted.withColumn("k", rank).where(F.col("k") <= COMMON)
    return best.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("k", "w", "n"))).alias("best"))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """A row per language: ``of``, its words ``n_reference``, its ``common`` words, and the shares of the character
    ``classes`` and of the common and all other ``words`` (null without any)."""
    plain = F.coalesce(F.col(text), F.lit(""))
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("of"), plain.alias("t"))
    parts = known.select("of", "t", words(F.col("t")).alias("l"), rest_of(F.col("t")).alias("r"))
    word_chars = F.length(F.array_join("l", ""))
    rows = parts.select("of", F.size("l").alias("n"), class_counts(F.col("t"), F.col("r"), word_chars).alias("c"))
    sums = [F.sum(F.get("c", F.lit(i))) for i in range(len(CLASSES))]
    totals = rows.groupBy("of").agg(F.sum("n").alias("n"), F.array(*sums).alias("c"))
    both = totals.join(common_words(known), "of", "left").withColumn("best", F.coalesce("best", F.array()))
    listed = F.concat(F.col("best.n"), F.array(F.col("n") - F.aggregate("best.n", F.lit(0).cast("long"), lambda a, x: a + x)))
    return both.select("of", F.col("n").alias("n_reference"), F.col("best.w").alias("common"), shares(F.col("c")).alias("classes"), shares(listed).alias("words"))


def shares(counts: Column) -> Column:
    """Counts as parts of their sum; null where that is 0."""
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(F.struct(counts.alias("c"), n.alias("n")), lambda x: F.when(x.n > 0, F.transform(x.c, lambda c: c / x.n)))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram to the shares of a reference; null without
    one or without counts. With m the mean of p and q it is the root of sum(p log p) / 2 +
    sum(q log q) / 2 - sum(m log m), in bits."""

    def total(terms: Column) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    def term(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x)).otherwise(0.0)

    def apart(x: Column) -> Column:
        middle = total(F.zip_with(x.p, x.q, lambda a, b: term((a + b) / 2)))
        return F.sqrt(F.greatest((total(F.transform(x.p, term)) + total(F.transform(x.q, term))) / 2 - middle, F.lit(0.0)))

    return let(F.struct(shares(counts).alias("p"), reference.alias("q")), apart)


def _languages(docs: DataFrame, refs: DataFrame, text: str, lang: str) -> DataFrame:
    """``docs`` with the language to judge each row by: its own, or that of its words."""
    own, key, guess = fresh(docs, "_of", "_text_key", "_guess")
    named = docs.where(F.col(lang).isNotNull()).withColumn(own, F.col(lang))
    bare = docs.where(F.col(lang).isNull()).withColumn(key, F.md5(F.coalesce(F.col(text), F.lit(""))))
    lexicon = refs.select(F.col("of").alias("of"), F.explode("common").alias("w"))
    held = bare.select(F.col(key).alias(key), F.explode(F.array_distinct(words(F.col(text)))).alias("w")).distinct()
    votes = held.join(lexicon, "w").groupBy(key, "of").agg(F.count("*").alias("n"))
    best = votes.groupBy(key).agg(F.min(F.struct(-F.col("n"), F.col("of"))).alias("best")).select(key, F.col("best.of").alias(guess))
    guessed = bare.join(best, key, "left").withColumnRenamed(guess, own).drop(key)
    return named.unionByName(guessed)


def judge(docs: DataFrame, refs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the counts, both distances (null below their least number of words and
    without a reference), ``base_failed`` and ``kept``. Columns of these names are replaced.

    The join with the references is a plain one: Spark broadcasts them by the size of their
    files and otherwise shuffles, with a hot language split by adaptive execution."""
    added = (*BASE, "class_distance", "common_distance", "base_failed", "kept")
    plain = F.coalesce(F.col(text), F.lit(""))
    cleared = docs.drop(*added)
    own, own_words, own_rest, common, classes, listed_shares = fresh(docs, "_of", "_words", "_rest", "_common", "_classes", "_shares")
    table = refs.where(F.col("n_reference") >= limits.reference_words).select(
        F.col("of").alias(own), F.col("common").alias(common), F.col("classes").alias(classes), F.col("words").alias(listed_shares)
    )
    joined = _languages(cleared, refs, text, lang).join(table, own, "left").drop(own)
    listed = joined.select("*", words(plain).alias(own_words), rest_of(plain).alias(own_rest))
    out = listed.select("*", *[c.alias(k) for k, c in base_columns(F.col(own_words), plain, F.col(own_rest)).items()])
    out = out.withColumn("base_failed", base_failed()).withColumns(
        {
            "class_distance": F.when(
                ~F.col("base_failed") & (F.col("n_words") >= limits.class_words) & F.col(classes).isNotNull(),
                distance(class_counts(plain, F.col(own_rest), F.col("word_chars")), F.col(classes)),
            ),
            "common_distance": F.when(
                ~F.col("base_failed") & (F.col("n_words") >= limits.common_words) & F.col(listed_shares).isNotNull(),
                distance(common_counts(F.col(own_words), F.col(common)), F.col(listed_shares)),
            ),
        }
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= limits.classes) & (
        F.coalesce("common_distance", F.lit(0.0)) <= limits.common
    )
    # Through a one-element generator: a later filter on the verdict would otherwise be put
    # in terms of the text, and the whole text taken apart again for every count in it.
    verdict = F.inline(F.array(F.struct((~F.col("base_failed") & near).alias("kept"))))
    columns = [F.col(f"`{c}`") for c in (*cleared.columns, *added[:-1])]
    return out.select(*columns, verdict)


def apply_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """References from ``docs`` (``text``, ``lang``) and the verdict on each row."""
    return judge(docs, written(references(docs), "references"), limits)


_L = Limits()
#: The rows of ``apply_rules`` with the default limits, without the distances.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n
  FROM (SELECT r, i, w[i:i + {WINDOW - 1}] AS k
        FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i) s)),
rep AS (
  SELECT r, count(DISTINCT i + o) AS n FROM win, (SELECT unnest(generate_series(0, {WINDOW - 1})) AS o) WHERE n > 1 GROUP BY r),
base AS (
  SELECT r, doc_id, lang, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
         - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
word AS (SELECT r, lang, unnest(w) AS v FROM d),
common AS (
  SELECT lang, v FROM (
    SELECT lang, v, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, v) AS k
    FROM word WHERE lang IS NOT NULL AND length(v) <= {COMMON_LETTERS} AND regexp_matches(v, '^\pL+$')
    GROUP BY lang, v) WHERE k <= {COMMON}),
guess AS (
  SELECT r, lang FROM (
    SELECT x.r, c.lang, row_number() OVER (PARTITION BY x.r ORDER BY count(*) DESC, c.lang) AS k
    FROM (SELECT DISTINCT r, v FROM word WHERE lang IS NULL) x JOIN common c USING (v) GROUP BY x.r, c.lang) WHERE k = 1),
own AS (SELECT d.r, coalesce(d.lang, guess.lang) AS of, d.lang IS NOT NULL AS named FROM d LEFT JOIN guess USING (r)),
bins AS (SELECT lang AS of, v FROM common UNION ALL SELECT DISTINCT of, NULL FROM own WHERE named),
hist AS (
  SELECT 'class' AS kind, r, bin::VARCHAR AS bin, c
  FROM (SELECT r, generate_series(1, 8) AS bins,
               list_transform(['[a-z]', '[A-Z]', '[\x20\x09-\x0D]', '[0-9]', '[#*$%&|<>!]', '[.,]'], lambda x: length(t) - length(regexp_replace(t, x, '', 'g'))) AS six,
               length(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS beyond, length(t) AS n FROM base) b,
       LATERAL (SELECT unnest(bins) AS bin, unnest(six || [n - beyond - list_sum(six), beyond]) AS c) x
  UNION ALL
  SELECT 'word', g.r, coalesce(g.v, ' '), coalesce(n.n, 0)
  FROM (SELECT own.r, bins.v FROM own JOIN bins USING (of)) g
  LEFT JOIN (
    SELECT x.r, common.v, count(*) AS n
    FROM (SELECT word.r, word.v, own.of FROM word JOIN own USING (r)) x LEFT JOIN common ON common.lang = x.of AND common.v = x.v
    GROUP BY ALL) n
    ON n.r = g.r AND n.v IS NOT DISTINCT FROM g.v),
share AS (SELECT *, c / greatest(sum(c) OVER (PARTITION BY kind, r), 1) AS p FROM hist),
ref AS (
  SELECT kind, of, bin, sum(c) / sum(sum(c)) OVER (PARTITION BY kind, of) AS q FROM hist JOIN own USING (r)
  WHERE named AND of IN (SELECT lang FROM d GROUP BY lang HAVING sum(len(w)) >= {_L.reference_words}) GROUP BY kind, of, bin),
apart AS (
  SELECT s.kind, s.r, sqrt(greatest(0,
           sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / 2
           - sum(CASE WHEN p + q > 0 THEN (p + q) / 2 * log2((p + q) / 2) ELSE 0 END))) AS j
  FROM share s JOIN own USING (r) JOIN ref ON ref.kind = s.kind AND ref.bin = s.bin AND ref.of = own.of
  WHERE q IS NOT NULL AND NOT isnan(q) GROUP BY s.kind, s.r),
least AS (
  SELECT r, min(j) FILTER (WHERE kind = 'class') AS classes, min(j) FILTER (WHERE kind = 'word') AS words FROM apart GROUP BY r),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_words < {_L.class_words} OR coalesce(classes, 0) <= {_L.classes})
       AND (n_words < {_L.common_words} OR coalesce(words, 0) <= {_L.common}) AS kept
FROM judged LEFT JOIN least USING (r)
"""
