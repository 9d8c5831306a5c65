"""Reading sample tables and listings."""

from __future__ import annotations

import json
from collections.abc import Mapping
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts that mean "missing" in a sample CSV.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _present(name: str) -> Column:
    text = F.col(f"`{name}`")
    return F.when(~text.isin(*NULL_TOKENS), text)


def _typed(name: str, kind: str) -> Column:
    """Cast a text column; a text that is neither missing nor valid stops the job."""
    present = _present(name)
    if kind == "string":
        return present.alias(name)
    number = present.try_cast("double")
    value = number if kind == "double" else number.try_cast(kind)
    if kind in ("int", "bigint"):  # long texts lose digits as doubles, so try the exact cast first
        value = F.coalesce(present.try_cast(kind), value)
    problem = F.raise_error(F.concat(F.lit(f"column {name} is not {kind}: "), present))
    return F.when(present.isNotNull(), F.coalesce(value, problem.cast(kind))).alias(name)


def infer_sample_types(raw: DataFrame) -> dict[str, str]:
    """int, bigint, double or string per column, found in one aggregate pass over text columns."""
    checks = []
    for i, name in enumerate(raw.columns):
        present = _present(name)
        number = F.when(present.isNotNull(), present.try_cast("double").isNotNull())
        digits = present.rlike("^\\s*[+-]?[0-9]+\\s*$")
        checks.append(F.coalesce(F.bool_and(number), F.lit(True)).alias(f"n{i}"))
        for mark, kind in (("i", "int"), ("l", "bigint")):
            whole = F.when(present.isNotNull(), digits & present.try_cast(kind).isNotNull())
            checks.append(F.coalesce(F.bool_and(whole), F.lit(False)).alias(f"{mark}{i}"))
    found = raw.agg(*checks).first()
    return {
        name: "int" if found[f"i{i}"] else "bigint" if found[f"l{i}"] else "double" if found[f"n{i}"] else "string"
        for i, name in enumerate(raw.columns)
    }


def read_samples(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str] | None = None,
    infer: bool = False,
) -> DataFrame:
    """Sample CSV with a header; the first column is a row index and is dropped.

    Without ``infer`` the crop code ``id`` is an integer and everything else a
    double, which needs no extra pass. ``types`` overrides single columns.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    raw = raw.select(*(f"`{c}`" for c in raw.columns[1:]))
    kinds = infer_sample_types(raw) if infer else {c: "double" for c in raw.columns}
    if not infer and "id" in kinds:
        kinds["id"] = "int"
    kinds.update(types or {})
    return raw.select(*(_typed(c, kinds[c]) for c in raw.columns))


# An attribute value is quoted either way or bare; script bodies and comments hold no links.
_HIDDEN_HTML = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
_ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


#: A reference to a character, by number or by name.
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
#: The names of HTML and what they stand for, from Python's own table.
_NAMED = json.dumps({f"&{name}": char for name, char in html5.items() if name.endswith(";")})


def decode_references(text: Column) -> Column:
    """A text with each ``&#39;``, ``&#x27;`` and ``&apos;`` as the character it stands for, read
    once: what a reference turns into is no part of another one. Unknown names, numbers of no
    character and names without a semicolon stay as they are."""
    names = F.from_json(F.lit(_NAMED), "map<string,string>")

    def character(reference: Column) -> Column:
        digits = F.regexp_extract(reference, "[0-9a-fA-F]+", 0)
        base = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).when(reference.startswith("&#"), digits).cast("bigint")
        valid = (base > 0) & (base < 0x110000) & ~base.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(base), 8, "0")), "UTF-32")
        return F.coalesce(F.when(valid, char), F.try_element_at(names, reference), reference)

    between = F.split(text, _REFERENCE, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), character)
    parts = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def list_links(
    pages: DataFrame, suffix: str = ".tif", prefix: Column | str = "", html: str = "html"
) -> DataFrame:
    """Every anchor target ending with ``suffix``, prefixed, as ``(..., position, url)``.

    ``pages`` is any table with an html column: whole pages, or the lines of one
    huge listing. ``position`` counts the anchors of a page in document order.
    """
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    visible = F.regexp_replace(F.col(html), _HIDDEN_HTML, "")
    others = [c for c in pages.columns if c != html]
    href = F.regexp_replace("href", "^[\"']|[\"']$", "")
    href = decode_references(href)
    return (
        pages.select(*others, start.alias("_prefix"), F.posexplode(
            F.regexp_extract_all(visible, F.lit(_ANCHOR), F.lit(1))
        ).alias("position", "href"))
        .withColumn("href", href)
        .filter(F.col("href").endswith(suffix))
        .select(*others, "position", F.concat("_prefix", "href").alias("url"))
    )
