"""URL filter lists that change over time, joined as of each capture's fetch.

A list has dated entries: from its date on a pattern is on the list (``add``) or off it
(``remove``). Entries become validity intervals, and a capture is held against the
intervals that hold on its fetch day. Kinds of patterns: ``host`` (the whole host),
``domain`` (the host or any parent domain), ``prefix`` (host and leading path segments,
``host/a/b``).

Whether a pattern is on a list depends on the day alone, so captures are first reduced to
distinct pattern and day, in which a host with a third of all captures is one row per day.
The as-of join sorts these with the pattern's intervals and carries the last interval
forward; what is active joins back to the captures by pattern and day, where adaptive
execution splits a frequent pattern.

Several entries of a list and pattern on one day: ``remove`` wins. Repeated entries have no
effect; nor have an entry without a date or pattern, and an action or kind of another name
is an error. Schemes and hosts compare in lower case, without user, port and trailing dot;
paths as they are, without query and fragment. A capture without a host or time is not
judged: ``blocked`` is null. Captures may repeat, and keep their columns; columns named
like the results are replaced, other names don't matter. Patterns may have any number of
labels or segments: of a capture's parent domains and leading segments those are formed
that are as long as the longest pattern of the lists at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmosaic.llm.common import fresh
from fieldmosaic.llm.native import let

KINDS = ("domain", "host", "prefix")
_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.$", "")
    return F.when(host != "", host)


def _patterns(url: Column, host: Column, labels: int, segments: int) -> Column:
    """All patterns that a URL meets, as (kind, pattern), of at most so many labels and
    segments."""
    parents = let(
        F.split(host, r"\."),
        lambda a: F.transform(
            F.when(F.lit(labels) > 0, F.sequence(F.greatest(F.lit(1), F.size(a) - labels + 1), F.size(a))).otherwise(F.array().cast("array<int>")),
            lambda i: F.array_join(F.slice(a, i, F.size(a)), "."),
        ),
    )
    path = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    prefixes = let(
        path,
        lambda a: F.transform(
            F.when(F.size(a) > 0, F.sequence(F.lit(1), F.least(F.size(a), F.lit(segments)))).otherwise(F.array().cast("array<int>")),
            lambda n: F.concat_ws("/", host, F.slice(a, F.lit(1), n)),
        ),
    )

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("pattern")))

    return F.concat(named("domain", parents), named("host", F.array(host)), named("prefix", prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """``list``, ``kind``, ``pattern``, ``valid_from``, ``valid_to`` (first day without, null:
    still valid), from entries with ``list``, ``kind``, ``pattern``, ``action``, ``day``.

    One state per day is left before the window, so a window holds at most one row per day.
    """
    known = F.col("action").isin("add", "remove") & F.col("kind").isin(*KINDS)
    checked = entries.where("day IS NOT NULL AND pattern IS NOT NULL AND list IS NOT NULL").select(
        "list", "kind", F.lower("pattern").alias("lowered"), "pattern", "day",
        F.when(known, F.col("action") == "remove").otherwise(F.raise_error(F.lit("unknown kind or action of a list entry"))).alias("off"),
    )
    keys = ["list", "kind", "pattern"]
    # a path keeps its letters, a host doesn't
    pattern = F.when(F.col("kind") == "prefix", F.concat(F.substring_index("lowered", "/", 1), F.expr("substr(pattern, length(substring_index(pattern, '/', 1)) + 1)"))).otherwise(F.col("lowered"))
    daily = checked.withColumn("pattern", pattern).groupBy(*keys, "day").agg(F.max("off").alias("off"))
    order = Window.partitionBy(*keys).orderBy("day")
    changes = daily.withColumn("was_off", F.coalesce(F.lag("off").over(order), F.lit(True))).where("off <> was_off")
    ends = changes.withColumn("valid_to", F.lead("day").over(order))
    return ends.where("NOT off").select(*keys, F.col("day").alias("valid_from"), "valid_to")


def active(keys: DataFrame, valid: DataFrame) -> DataFrame:
    """``keys`` (distinct ``kind``, ``pattern``, ``day``) that are on a list that day, with
    ``list`` and ``valid_from``: an as-of join on the last interval that began."""
    listed = valid.select("list", "kind", "pattern").distinct()
    asked = keys.join(listed, ["kind", "pattern"]).select(
        "list", "kind", "pattern", "day", F.lit(1).alias("asks"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
    )
    began = valid.select("list", "kind", "pattern", F.col("valid_from").alias("day"), F.lit(0).alias("asks"), "valid_from", "valid_to")
    order = Window.partitionBy("list", "kind", "pattern").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("asks") == 0, F.struct("valid_from", "valid_to")), ignorenulls=True).over(order)
    return (
        asked.union(began).withColumn("last", last)
        .where("asks = 1 AND last IS NOT NULL AND (last.valid_to IS NULL OR day < last.valid_to)")
        .select("list", "kind", "pattern", "day", "last.valid_from")
    )


def evaluate(captures: DataFrame, entries: DataFrame, key: str, url: str = "url", time: str = "fetch_time") -> DataFrame:
    """``captures`` with ``host``, ``blocked``, ``n_matches`` (patterns on lists that day),
    ``lists`` (their names in order, with commas) and ``since`` (the first day of the oldest
    of these intervals). ``key`` names rows; rows with one key have one result each all the
    same, as URL and time go along."""
    added = ("host", "blocked", "n_matches", "lists", "since")
    rows = captures.select(*[c for c in captures.columns if c not in added], host_of(F.col(url)).alias("host"))
    valid = intervals(entries)
    parts = F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1), F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))
    depth, labels = (n or 0 for n in entries.agg(*map(F.max, parts)).first())
    of_key, of_url, of_day = fresh(rows, "_key", "_url", "_day")
    names = {"_key": F.col(f"`{key}`"), "_url": F.col(f"`{url}`"), "_day": F.col(f"`{time}`").cast("date")}
    met = (
        rows.where(F.col("host").isNotNull() & F.col(time).isNotNull())
        .select(*[c.alias(n) for n, c in names.items()], F.explode(_patterns(F.col(url), F.col("host"), labels, depth)).alias("p"))
        .select("_key", "_url", F.col("_day").alias("day"), "p.kind", "p.pattern")
        .distinct()
    )
    hits = met.join(active(met.select("kind", "pattern", "day").distinct(), valid), ["kind", "pattern", "day"])
    found = hits.groupBy(F.col("_key").alias(of_key), F.col("_url").alias(of_url), F.col("day").alias(of_day)).agg(
        F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("valid_from").alias("since")
    )
    joined = rows.join(
        found, F.col(f"`{key}`").eqNullSafe(F.col(of_key)) & (F.col(url) == F.col(of_url)) & (F.col(time).cast("date") == F.col(of_day)), "left"
    )
    judged = F.col("host").isNotNull() & F.col(time).isNotNull()
    return joined.select(
        *rows.columns,
        F.when(judged, F.col("n_matches").isNotNull()).alias("blocked"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        "since",
    )
