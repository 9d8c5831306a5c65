"""A mosaic job in stages that are written down and can be resumed, zone by zone."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmosaic.functions.naming import UNKNOWN_ZONE
from fieldmosaic.operators.raster import combine_zones, mosaic_pixels, overview_pyramid, warp_zones
from fieldmosaic.operators.tiles import with_zone, zone_mosaic
from fieldmosaic.session import broadcast_if_small
from fieldmosaic.sources.sinks import publish_partitions
from fieldmosaic.sources.store import Parts, VersionedTable, file_states

#: Coordinate systems of one job at most; their names are fetched to see which are missing.
MAX_ZONES = 10_000
#: Listed tiles up to which their numbers are sent to every task; more are joined by shuffle.
MAX_LISTED = 500_000


@dataclass(frozen=True)
class Stage:
    """One step, from the given and the written tables that it reads to its own table.

    ``settings`` is whatever, besides the input, its rows follow from.
    """

    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    reads: tuple[str, ...] = ()  # stages, besides the given tables
    partition: str | None = "zone"  # written as one folder per value
    settings: tuple[object, ...] = ()

    @property
    def by_zone(self) -> bool:
        return self.partition == "zone"


def fingerprint(df: DataFrame) -> str:
    """A short text that changes with the input and is the same in every process.

    A table read from files alone is known by their paths, lengths and times of change and
    by the plan over them, so nothing is read to find out that there is nothing to do.
    Other tables, and plans that hold functions or subqueries whose text doesn't tell all,
    are known by their rows, in any order.
    """
    files = df.inputFiles()
    plan = _plan_text(df) if files else None
    if plan is not None:
        return _digest(*file_states(df.sparkSession, files), plan, df.schema)
    row_hash = F.xxhash64(*(f"`{c}`" for c in df.columns))
    got = df.agg(
        F.count(F.lit(1)), F.bit_xor(row_hash), F.sum(row_hash.cast("decimal(38,0)"))
    ).first()
    return _digest(*got, df.schema)


def _digest(*parts: object) -> str:
    return hashlib.sha256("\n".join(map(str, parts)).encode()).hexdigest()[:16]


def _plan_text(df: DataFrame) -> str | None:
    """The analysed plan with its expressions numbered in order of appearance, as their own
    numbers come from the process; None where the text doesn't hold all that the rows follow
    from."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return None
    setting, before = "spark.sql.debug.maxToStringFields", spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set(setting, "1000000")  # else long column lists are cut
    try:
        text = plan.toString()
    finally:
        spark.conf.set(setting, before)
    if re.search(r"UDF|subquery|exists#|MapIn|Sample|rand\w*\(|uuid\(|current_|\.\.\. \d+ more", text):
        return None
    seen: dict[str, str] = {}
    return re.sub(r"#\d+|\b[xyz]_\d+\b", lambda m: seen.setdefault(m[0], f"#{len(seen)}"), text)


def stage_paths(inputs: Mapping[str, DataFrame], stages: Sequence[Stage], base: str) -> dict[str, str]:
    """A folder per stage, named after its input, its own settings and, through their names,
    those of all stages that it reads."""
    given = _digest(*(f"{name} {fingerprint(df)}" for name, df in sorted(inputs.items())))
    names: dict[str, str] = {}
    for stage in stages:
        names[stage.name] = _digest(given, stage.name, stage.settings, *(names[r] for r in stage.reads))
    return {n: f"{base.rstrip('/')}/{n}-{d}" for n, d in names.items()}


def _remade(stages: Sequence[Stage], overwrite: Collection[str]) -> set[str]:
    """The stages named, and all that read one of them."""
    unknown = set(overwrite) - {s.name for s in stages}
    if unknown:
        raise ValueError(f"no such stage: {', '.join(sorted(unknown))}")
    out = set(overwrite)
    for stage in stages:
        if out & set(stage.reads):
            out.add(stage.name)
    return out


def run_stages(
    source: DataFrame | Mapping[str, DataFrame],
    stages: Sequence[Stage],
    base: str,
    clean: bool = False,
    overwrite: Collection[str] = (),
    publish: str | None = None,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Bring the last stage about, making only what is missing.

    ``source`` is the table of pixels, or several tables by name, pixels as ``source``. A
    stage's folder follows from the input and from all settings it depends on, so changed
    settings never meet old tables, and a later process finds what an earlier one made.
    Stages by zone are resumed by zone: of zones listed by the ``index`` stage those are made
    that a later stage needs and that are not there whole. Stages named in ``overwrite``, and
    those that read them, are made anew for all zones. A stage counts once its manifest is
    there; of two jobs on one base, the first to finish a zone has made it. Below
    ``publish``, finished zones and the last table replace what is there of them, by stage
    name, each stage at once.

    Returns the last table, and per stage that ran the zones it made (none for a table that
    is made as a whole). ``clean`` removes the earlier tables.
    """
    inputs = dict(source) if isinstance(source, Mapping) else {"source": source}
    spark = inputs["source"].sparkSession
    again = _remade(stages, overwrite)
    stores = {n: VersionedTable(spark, p, s.partition) for s, (n, p) in zip(stages, stage_paths(inputs, stages, base).items(), strict=True)}
    said = {n: store.parts() for n, store in stores.items()}
    known: dict[str, Parts] = {}
    for stage in stages:
        good = stores[stage.name].intact() if stage.name not in again else {}
        known[stage.name] = good if stage.by_zone or len(good) == len(said[stage.name]) else {}
    tables, ran = dict(inputs), {}

    def make(stage: Stage, zones: Sequence[str] | None) -> None:
        store, before = stores[stage.name], said[stage.name]
        out = stage.build(tables)
        if zones is not None:
            out = out.filter(F.col("zone").isin(list(zones)))
        made = store.write(out)
        if not made and zones is None:
            raise RuntimeError(f"stage {stage.name} wrote no data")
        if zones is not None:
            # a zone without data has no folder; it is recorded all the same, as made
            made = {f"zone={z}": made.get(f"zone={z}", ("", 0)) for z in zones}
            if not any(size for _, size in (*made.values(), *known[stage.name].values())):
                raise RuntimeError(f"stage {stage.name} wrote no data")

        def settled(now: Parts) -> Parts:
            """What another job has made since this one looked stays."""
            if zones is None:
                return made if now == before else now
            return {**now, **{k: v for k, v in made.items() if now.get(k) == before.get(k)}}

        held = store.commit(settled)
        ran[stage.name] = list(zones or [])
        known[stage.name] = held if zones is None else {k: v for k, v in held.items() if k in known[stage.name] or k in made}
        tables[stage.name] = store.read(known[stage.name])
        if publish and (stage.by_zone or stage is stages[-1]):
            done = tables[stage.name]
            publish_partitions(done.filter(F.col("zone").isin(list(zones))) if zones else done, f"{publish}/{stage.name}", stage.partition)

    by_name = {s.name: s for s in stages}
    wanted: list[str] = []
    if "index" in by_name:
        if not known["index"]:
            make(by_name["index"], None)
        tables["index"] = stores["index"].read(known["index"])
        found = tables["index"].select("zone").orderBy("zone").limit(MAX_ZONES + 1).collect()
        if len(found) > MAX_ZONES:
            raise ValueError(f"more than {MAX_ZONES} coordinate systems")
        wanted = [r["zone"] for r in found]
        if not wanted:
            raise RuntimeError("stage index wrote no data")
    todo: dict[str, list[str] | None] = {}
    asked: dict[str, set[str]] = {name: set(wanted) for name in (stages[-1].name, *again)}
    for stage in reversed(stages):
        if stage.name not in asked or stage.name == "index":
            continue
        if stage.by_zone:
            missing = [z for z in wanted if z in asked[stage.name] and f"zone={z}" not in known[stage.name]]
            todo[stage.name] = missing
        else:
            missing = wanted if not known[stage.name] else []
            todo[stage.name] = None if missing else []
        if missing:
            for name in stage.reads:
                asked.setdefault(name, set()).update(missing)
    for stage in stages:
        zones = todo.get(stage.name, [])
        if zones is None or zones:
            make(stage, zones)
        elif any(size for _, size in known[stage.name].values()):
            tables[stage.name] = stores[stage.name].read(known[stage.name])
    if clean:
        for stage in stages[:-1]:
            if stage.name != "index":  # small, and what a later run starts from
                stores[stage.name].remove()
        stores[stages[-1].name].sweep()
    return tables[stages[-1].name], ran


def mosaic_stages(
    source_resolution: float, target_resolution: float, levels: Sequence[int] = (32, 64, 128)
) -> list[Stage]:
    """Index, tiles to zones, zone mosaics, reprojected zones, combined mosaic with overviews.

    The table ``source`` holds one row per tile pixel: ``seq, srs, px, py, value``. Tables
    ``tiles`` (``seq, url, srs`` and extent) and ``links`` (``url``), if given, make the
    index: tiles that a listing has, by zone. The mosaic then holds pixels of these tiles
    alone. Pixels in a zone that no tile of the table accounts for stop the job, unless their
    system is unreadable. Without ``tiles`` the index comes from the pixels.
    """

    def listed(t: dict[str, DataFrame]) -> DataFrame:
        return t["tiles"].join(t["links"].select("url").distinct(), "url", "left_semi") if "links" in t else t["tiles"]

    def index(t: dict[str, DataFrame]) -> DataFrame:
        if "tiles" not in t:
            known = with_zone(t["source"]).filter(F.col("zone") != UNKNOWN_ZONE)
            return known.groupBy("zone").agg(F.min("seq").alias("first_seq"))
        tiles = with_zone(t["tiles"]).select("seq", "zone").distinct()
        found = with_zone(t["source"]).filter(F.col("zone") != UNKNOWN_ZONE).groupBy("seq", "zone").agg(F.count(F.lit(1)).alias("pixels"))
        lost = found.join(tiles, ["seq", "zone"], "left_anti").first()
        if lost:
            raise ValueError(f"tile {lost['seq']} has {lost['pixels']} pixels in {lost['zone']}, but no row with this zone among the tiles")
        return zone_mosaic(listed(t))

    def zones(t: dict[str, DataFrame]) -> DataFrame:
        pixels = t["source"]
        if "tiles" in t:
            pixels = pixels.join(broadcast_if_small(listed(t).select("seq").distinct(), MAX_LISTED), "seq", "left_semi")
        return with_zone(pixels).drop("srs")

    def combined(t: dict[str, DataFrame]) -> DataFrame:
        order = t["index"].select("zone", F.col("first_seq").alias("zone_seq"))
        # The mosaic itself is level 1, the overviews follow.
        cells = combine_zones(t["reprojected"], order).withColumnsRenamed({"cx": "px", "cy": "py"})
        return overview_pyramid(cells, (1, *levels))

    return [
        Stage("index", index, partition=None),
        Stage("zones", zones, ("index",)),
        Stage("zone_mosaics", lambda t: mosaic_pixels(t["zones"]), ("zones",)),
        Stage(
            "reprojected",
            lambda t: warp_zones(t["zone_mosaics"], source_resolution, target_resolution),
            ("zone_mosaics",),
            settings=(float(source_resolution), float(target_resolution)),
        ),
        Stage("combined", combined, ("index", "reprojected"), partition="level", settings=tuple(sorted(set(levels)))),
    ]
