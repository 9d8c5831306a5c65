"""The registered queries as SQL for an independent engine, over the same tables.

Fixture tables share their defining expressions with the queries; everything the
operators do is written again here.
"""

from __future__ import annotations

from fieldmosaic import fixtures
from fieldmosaic.functions import codes
from fieldmosaic.plans.scenarios import SCENARIOS

TYPE_NAMES = sorted([*codes.TYPE_CLASSES, codes.OTHER_CLASS])

TYPE_CASE = """CASE
    WHEN id IN (1100, 1110, 1120) THEN '1100' WHEN id IN (1500, 1510, 1520) THEN '1500'
    WHEN id IN (1900, 1910, 1920) THEN '1900' WHEN id = 1200 THEN '1200'
    WHEN id IN (4350, 4351, 4352) THEN '4350' WHEN id = 5100 THEN '5100'
    WHEN id = 8100 THEN '8100' WHEN id IN (9100, 9110, 9120) THEN '9100' ELSE '0' END"""
SEASON_CASE = """CASE
    WHEN id IN (1110, 1510, 1910) THEN '1910' WHEN id IN (1120, 1520, 1920) THEN '1920'
    WHEN id = 1200 THEN '1200' WHEN id IN (4350, 4351, 4352) THEN '4350'
    WHEN id = 5100 THEN '5100' WHEN id = 8100 THEN '8100'
    WHEN id IN (9100, 9110, 9120) THEN '9100' ELSE '0' END"""

NO_NULL = "B06_p50 IS NOT NULL"  # the only column of the fixture with nulls
NOT_TYPE = "id NOT IN (0, 1000, 991, 9998)"
NOT_SEASON = "id NOT IN (0, 1000, 991, 9998, 1100, 1500, 1900)"
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""


def _hash(key: str, seed: str = "") -> str:
    text = f"'{seed}:' || {key}" if seed else key
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _with(*parts: tuple[str, str], then: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in parts) + " " + then


CROP = ("crop", fixtures.derive_sql("lineitem", *fixtures.CROP))
KEYED = ("crop", fixtures.derive_sql("lineitem", *fixtures.CROP, (fixtures.KEY, "key")))
WIDE = ("wide", fixtures.derive_sql("lineitem", *fixtures.WIDE))
LABELLED = (KEYED, ("labelled", f"SELECT *, {TYPE_CASE} AS label FROM crop"))
PREPARED = (
    CROP,
    ("twice", "SELECT * FROM crop UNION ALL SELECT * FROM crop"),
    ("labelled", f"SELECT *, {TYPE_CASE} AS label FROM (SELECT DISTINCT * FROM twice) WHERE {NO_NULL} AND {NOT_TYPE}"),
    ("counts", "SELECT label, count(*) AS n FROM labelled GROUP BY label"),
)
_BALANCED = "(SELECT sum(n)::DOUBLE / count(*) FROM counts) / n"

_FOLLOWING = " ".join(
    f"WHEN '{a}' THEN '{b}'" for a, b in zip(TYPE_NAMES, TYPE_NAMES[1:] + TYPE_NAMES[:1])
)
PREDICTED = (
    *LABELLED,
    (
        "predicted",
        f"SELECT *, CASE WHEN {_hash('key')} >= {round(0.8 * 2**32)} THEN CASE label {_FOLLOWING} END "
        "ELSE label END AS prediction FROM labelled",
    ),
)
PER_CLASS = (
    *PREDICTED,
    ("actual", "SELECT label AS class, count(*) AS support FROM predicted GROUP BY 1"),
    ("guessed", "SELECT prediction AS class, count(*) AS n FROM predicted GROUP BY 1"),
    ("hits", "SELECT label AS class, count(*) AS tp FROM predicted WHERE label = prediction GROUP BY 1"),
    (
        "shares",
        "SELECT class, coalesce(support, 0) AS support, "
        "coalesce(coalesce(tp, 0)::DOUBLE / n, 0) AS p, coalesce(coalesce(tp, 0)::DOUBLE / support, 0) AS r "
        "FROM actual FULL JOIN guessed USING (class) LEFT JOIN hits USING (class)",
    ),
    (
        "scores",
        'SELECT class, p AS "precision", r AS recall, '
        "CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2::DOUBLE * p * r / (p + r) END AS fscore, support FROM shares",
    ),
)
BANDS = (
    CROP,
    (
        "bands",
        " UNION ALL ".join(
            f"SELECT '{b}' AS band, count(*) FILTER (\"{b}\" > {v})::DOUBLE / count(*) AS importance FROM crop"
            for b, v in (("B06_p50", 2500), ("B06_sd", 1), ("NDVI_p50", 500), ("VV_p50", 1000))
        ),
    ),
)
GUESSES = (
    *LABELLED,
    ("folded", f"SELECT label, ({_hash('key', 'fold')} * 3) >> 32 AS fold FROM labelled"),
    ("guesses", "SELECT unnest([" + ", ".join(f"'{n}'" for n in TYPE_NAMES) + "]) AS guess"),
    (
        "per_fold",
        "SELECT guess, fold, count(*) FILTER (label = guess)::DOUBLE / count(*) AS score "
        "FROM folded, guesses GROUP BY guess, fold",
    ),
    (
        "candidates",
        "SELECT 'always=' || guess AS params, round(avg(score), 12) AS mean_test_score FROM per_fold GROUP BY guess",
    ),
)

TILES = (
    ("tiles", fixtures.derive_sql("events", *fixtures.TILES)),
    (
        "zoned",
        "SELECT *, replace(replace(replace(srs, ' ', ''), chr(10), ''), ':', '') AS epsg, "
        "CASE WHEN srs = '' THEN 'unknown' ELSE 'EPSG' || right(srs, 5) END AS zone FROM tiles",
    ),
)
PIXELS = (
    ("raw", fixtures.derive_sql("events", *fixtures.PIXELS)),
    ("pixels", "SELECT *, 'EPSG' || right(srs, 5) AS zone FROM raw WHERE srs <> ''"),
    (
        "mosaic",
        "SELECT zone, px, py, value, seq FROM pixels WHERE value IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY zone, px, py ORDER BY seq DESC) = 1",
    ),
)
GRID = (
    PIXELS[0],
    (
        "cells",
        "SELECT px, py, value FROM raw WHERE value IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY seq DESC) = 1",
    ),
)


def _utm_to_laea(source: str, columns: str) -> tuple[tuple[str, str], ...]:
    """CTEs ending in ``moved``: ``source`` (zone, x, y, columns) with ``tx, ty``.

    UTM grid to latitude by the Krueger series in the third flattening; then the ellipsoidal Lambert azimuthal equal-area of EPSG:3035.
    """
    return (
        (
            "k",
            "SELECT n, 6378137.0::DOUBLE / (1 + n) * (1 + n*n/4 + n*n*n*n/64) * 0.9996::DOUBLE AS big, "
            "n/2 - 2*n*n/3 + 37*n*n*n/96 - n*n*n*n/360 AS b1, n*n/48 + n*n*n/15 - 437*n*n*n*n/1440 AS b2, "
            "17*n*n*n/480 - 37*n*n*n*n/840 AS b3, 4397*n*n*n*n/161280 AS b4, "
            "2*n - 2*n*n/3 - 2*n*n*n + 116*n*n*n*n/45 AS d1, 7*n*n/3 - 8*n*n*n/5 - 227*n*n*n*n/45 AS d2, "
            "56*n*n*n/15 - 136*n*n*n*n/35 AS d3, 4279*n*n*n*n/630 AS d4 "
            "FROM (SELECT 1::DOUBLE / (2 * 298.257223563::DOUBLE - 1) AS n)",
        ),
        (
            "e",
            "SELECT *, sqrt(e2) AS ecc, radians(52.0::DOUBLE) AS lat0, radians(10.0::DOUBLE) AS lon0 "
            "FROM (SELECT 2 * f - f * f AS e2 FROM (SELECT 1 / 298.257222101::DOUBLE AS f))",
        ),
        (
            "q",
            "SELECT *, (1-e2) * (1/(1-e2) - ln((1-ecc)/(1+ecc))/(2*ecc)) AS qp, "
            "(1-e2) * (sin(lat0)/(1-e2*sin(lat0)**2) - ln((1-ecc*sin(lat0))/(1+ecc*sin(lat0)))/(2*ecc)) AS q0 FROM e",
        ),
        (
            "p",
            "SELECT *, asin(q0/qp) AS beta0, 6378137.0::DOUBLE * sqrt(qp/2) AS rq, "
            "cos(lat0) / sqrt(1-e2*sin(lat0)**2) / (sqrt(qp/2) * cos(asin(q0/qp))) AS d FROM q",
        ),
        (
            "g1",
            f"SELECT zone, x, y, {columns}, y / big AS xi, (x - 500000::DOUBLE) / big AS eta, k.* FROM {source}, k",
        ),
        (
            "g2",
            f"SELECT zone, x, y, {columns}, d1, d2, d3, d4, "
            "xi - b1*sin(2*xi)*cosh(2*eta) - b2*sin(4*xi)*cosh(4*eta) - b3*sin(6*xi)*cosh(6*eta) - b4*sin(8*xi)*cosh(8*eta) AS u, "
            "eta - b1*cos(2*xi)*sinh(2*eta) - b2*cos(4*xi)*sinh(4*eta) - b3*cos(6*xi)*sinh(6*eta) - b4*cos(8*xi)*sinh(8*eta) AS v FROM g1",
        ),
        ("g3", "SELECT *, asin(sin(u)/cosh(v)) AS chi FROM g2"),
        (
            "g4",
            f"SELECT zone, x, y, {columns}, chi + d1*sin(2*chi) + d2*sin(4*chi) + d3*sin(6*chi) + d4*sin(8*chi) AS lat, "
            "radians((right(zone, 2)::INT * 6 - 183)::DOUBLE) + atan2(sinh(v), cos(u)) AS lon FROM g3",
        ),
        (
            "g5",
            f"SELECT zone, x, y, {columns}, lon - lon0 AS dl, beta0, rq, d, "
            "asin((1-e2) * (sin(lat)/(1-e2*sin(lat)**2) - ln((1-ecc*sin(lat))/(1+ecc*sin(lat)))/(2*ecc)) / qp) AS beta FROM g4, p",
        ),
        (
            "g6",
            "SELECT *, rq * sqrt(2 / (1 + sin(beta0)*sin(beta) + cos(beta0)*cos(beta)*cos(dl))) AS b FROM g5",
        ),
        (
            "moved",
            f"SELECT zone, x, y, {columns}, 4321000::DOUBLE + b*d*cos(beta)*sin(dl) AS tx, "
            "3210000::DOUBLE + b/d*(cos(beta0)*sin(beta) - sin(beta0)*cos(beta)*cos(dl)) AS ty FROM g6",
        ),
    )


MOVED = (
    *PIXELS,
    (
        "centres",
        "SELECT zone, px, py, value, (px + 0.5::DOUBLE) * 10000::DOUBLE AS x, "
        "(py + 0.5::DOUBLE) * 10000::DOUBLE AS y FROM mosaic",
    ),
    *_utm_to_laea("centres", "px, py, value"),
)
REGRID = (
    *MOVED,
    (
        "placed",
        "SELECT *, floor(tx/10000)::BIGINT AS cx, floor(ty/10000)::BIGINT AS cy FROM moved",
    ),
    (
        "regridded",
        "SELECT zone, cx, cy, value FROM placed QUALIFY row_number() OVER (PARTITION BY zone, cx, cy ORDER BY "
        "floor(sqrt((tx-(cx+0.5::DOUBLE)*10000)**2 + (ty-(cy+0.5::DOUBLE)*10000)**2) * 1000), px, py) = 1",
    ),
)


def _laea_to_utm(source: str) -> tuple[tuple[str, str], ...]:
    """CTEs ending in ``placed``: ``source`` (zone, cx, cy) with the UTM place of the cell centre.

    Uses the constants ``e, q, p`` and ``k`` of ``_utm_to_laea``.
    """
    return (
        (
            "h1",
            "SELECT zone, cx, cy, ((cx + 0.5::DOUBLE) * 10000 - 4321000) / d AS dx, "
            f"((cy + 0.5::DOUBLE) * 10000 - 3210000) * d AS dy, p.* FROM {source}, p",
        ),
        ("h2", "SELECT *, sqrt(dx*dx + dy*dy) AS rho, 2 * asin(sqrt(dx*dx + dy*dy) / (2*rq)) AS ce FROM h1"),
        (
            "h3",
            "SELECT *, asin(cos(ce)*sin(beta0) + dy*sin(ce)*cos(beta0)/rho) AS ba, "
            "lon0 + atan2(dx*sin(ce), rho*cos(beta0)*cos(ce) - dy*sin(beta0)*sin(ce)) AS lon FROM h2",
        ),
        (
            "h4",
            "SELECT zone, cx, cy, lon - radians((right(zone, 2)::INT * 6 - 183)::DOUBLE) AS dl, "
            "ba + (e2/3 + 31*e2**2/180 + 517*e2**3/5040) * sin(2*ba) "
            "+ (23*e2**2/360 + 251*e2**3/3780) * sin(4*ba) + 761*e2**3/45360 * sin(6*ba) AS lat FROM h3",
        ),
        (
            "h5",
            "SELECT zone, cx, cy, dl, big, n/2 - 2*n*n/3 + 5*n*n*n/16 + 41*n*n*n*n/180 AS a1, "
            "13*n*n/48 - 3*n*n*n/5 + 557*n*n*n*n/1440 AS a2, 61*n*n*n/240 - 103*n*n*n*n/140 AS a3, "
            "49561*n*n*n*n/161280 AS a4, sinh(atanh(sin(lat)) - 2*sqrt(n)/(1+n) * atanh(2*sqrt(n)/(1+n) * sin(lat))) AS t FROM h4, k",
        ),
        ("h6", "SELECT *, atan2(t, cos(dl)) AS u, asinh(sin(dl) / sqrt(t*t + cos(dl)**2)) AS v FROM h5"),
        (
            "located",
            "SELECT zone, cx, cy, 500000 + big * (v + a1*cos(2*u)*sinh(2*v) + a2*cos(4*u)*sinh(4*v) + a3*cos(6*u)*sinh(6*v) + a4*cos(8*u)*sinh(8*v)) AS x, "
            "big * (u + a1*sin(2*u)*cosh(2*v) + a2*sin(4*u)*cosh(4*v) + a3*sin(6*u)*cosh(6*v) + a4*sin(8*u)*cosh(8*v)) AS y FROM h6",
        ),
    )


# The hole-free warp from the target's side: project every cell near a moved pixel
# back and look up the zone cell it falls in.
_STACK = ("stack", "SELECT zone, min(seq) AS zone_seq FROM pixels GROUP BY zone")
WARP = (
    *MOVED,
    ("shifts", "SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS s"),
    (
        "near",
        "SELECT DISTINCT zone, floor(tx/10000)::BIGINT + a.s AS cx, floor(ty/10000)::BIGINT + b.s AS cy "
        "FROM moved, shifts a, shifts b",
    ),
    *_laea_to_utm("near"),
    (
        "warped",
        "SELECT l.zone, cx, cy, value FROM located l JOIN mosaic m ON m.zone = l.zone "
        "AND m.px = floor(l.x/10000)::BIGINT AND m.py = floor(l.y/10000)::BIGINT",
    ),
)


def _pyramid(levels: tuple[int, ...], value: str) -> str:
    parts = (
        f"SELECT {level} AS level, floor(px / {level})::BIGINT AS bx, floor(py / {level})::BIGINT AS by, "
        f"{value} AS value FROM cells GROUP BY 2, 3"
        for level in levels
    )
    return " UNION ALL ".join(parts)


def _links(prefix: str, suffix: str) -> str:
    visible = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g')"
    return f"""
        WITH anchors AS (SELECT page_id, url AS page, regexp_extract_all({visible}, '{ANCHOR}', 1) AS found FROM pages),
        links AS (SELECT page_id, page, unnest(found) AS quoted, generate_subscripts(found, 1) - 1 AS position FROM anchors),
        clean AS (SELECT page_id, page, position, replace(replace(replace(replace(replace(
            trim(quoted, '"'''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS href FROM links)
        SELECT page_id, position, {prefix} || href AS url FROM clean WHERE suffix(href, '{suffix}')"""


def statements() -> dict[str, str]:
    crop_columns = ", ".join(f'"{name}"' for _, name in fixtures.CROP)
    wide_names = codes.feature_names()
    small = ", ".join(f'"{n}"' for n in codes.small_feature_names())
    wide_bands = ", ".join(f'"{n}"' for n in wide_names)
    distinct = ("crop", f"SELECT DISTINCT {crop_columns} FROM ({CROP[1]})")
    s = {}

    s["read_csv"] = _with(CROP, then="SELECT * FROM crop")
    s["read_csv_inferred"] = fixtures.derive_sql("lineitem", *fixtures.CROP, fixtures.SERIAL)
    s["drop_duplicates"] = _with(distinct, then="SELECT * FROM crop")
    s["clean_samples"] = _with(distinct, then=f"SELECT * FROM crop WHERE {NO_NULL}")
    s["drop_nulls"] = s["require_band"] = _with(CROP, then=f"SELECT * FROM crop WHERE {NO_NULL}")
    s["preview"] = _with(KEYED, then="SELECT * FROM crop ORDER BY key LIMIT 5")
    s["cast_strata"] = _with(CROP, then="SELECT * FROM crop")
    s["cast_all_int"] = _with(
        WIDE,
        then="SELECT "
        + ", ".join(f'trunc("{n}")::BIGINT AS "{n}"' for n in ("id", "groupID", "zoneID", *wide_names))
        + f" FROM wide WHERE {NO_NULL}",
    )
    s["exclude_type"] = _with(CROP, then=f"SELECT * FROM crop WHERE {NOT_TYPE}")
    s["exclude_season"] = _with(CROP, then=f"SELECT * FROM crop WHERE {NOT_SEASON}")
    s["stratum_46000"] = _with(CROP, then='SELECT * FROM crop WHERE "groupID" = 46000')
    s["stratum_22000"] = _with(CROP, then='SELECT * FROM crop WHERE "groupID" = 22000')
    s["stratum_43000_6000"] = _with(CROP, then='SELECT * FROM crop WHERE "groupID" IN (43000, 6000)')
    s["select_small"] = _with(WIDE, then=f"SELECT {small}, {TYPE_CASE} AS label FROM wide")
    s["select_full"] = _with(
        WIDE, then=f'SELECT "groupID", "zoneID", {wide_bands}, {SEASON_CASE} AS label FROM wide'
    )
    s["feature_names"] = _with(
        WIDE,
        (
            "present",
            " UNION ALL ".join(
                f"SELECT {i} AS position, '{n.split('_')[0]}' AS layer, '{n.split('_')[1]}' AS stat, "
                f"'{n}' AS feature, count(\"{n}\") AS samples FROM wide"
                for i, n in enumerate(wide_names)
            ),
        ),
        then="SELECT * FROM present",
    )

    s["label_type"] = _with(CROP, then=f"SELECT id, B06_sd, {TYPE_CASE} AS label FROM crop")
    s["label_season"] = _with(CROP, then=f"SELECT id, B06_sd, {SEASON_CASE} AS label FROM crop")
    s["label_type_int"] = _with(
        CROP, then=f"SELECT id, B06_p50, CAST({TYPE_CASE} AS INT) AS y1 FROM crop WHERE {NO_NULL} AND {NOT_TYPE}"
    )
    s["label_from_table"] = _with(CROP, then=f"SELECT id, NDVI_p50, {SEASON_CASE} AS label FROM crop")
    s["class_counts"] = _with(
        CROP,
        then="SELECT id, "
        + ", ".join(f'count("{n}") AS "{n}"' for _, n in fixtures.CROP if n != "id")
        + " FROM crop WHERE id IS NOT NULL GROUP BY id",
    )
    s["balanced_weights"] = _with(*PREPARED, then=f"SELECT label, n, {_BALANCED} AS weight FROM counts")
    s["balanced_weights_override"] = _with(
        *PREPARED,
        then=f"SELECT label, n, CASE WHEN label = '0' THEN 3.5::DOUBLE ELSE {_BALANCED} END AS weight FROM counts",
    )
    s["auto_weights"] = _with(
        *PREPARED, then="SELECT label, n, (SELECT max(n) FROM counts)::DOUBLE / n AS weight FROM counts"
    )
    s["weighted_samples"] = _with(
        *LABELLED,
        ("counts", "SELECT label, count(*) AS n FROM labelled GROUP BY label"),
        ("weights", f"SELECT label, {_BALANCED} AS weight FROM counts"),
        then="SELECT key, label, weight FROM labelled JOIN weights USING (label)",
    )

    s["assembled"] = _with(
        KEYED,
        then=f"SELECT key, 4::BIGINT AS n_features, B06_p50 AS f0, B06_sd AS f1, NDVI_p50 AS f2, VV_p50 AS f3 FROM crop WHERE {NO_NULL}",
    )
    s["split_hash"] = _with(
        KEYED, then=f"SELECT key, {_hash('key', '190')} >= {round(0.7 * 2**32)} AS is_test FROM crop"
    )
    s["pools"] = _with(
        *LABELLED,
        ("flagged", f"SELECT label, {_hash('key', '190')} >= {round(0.7 * 2**32)} AS is_test FROM labelled"),
        then="SELECT label, is_test, is_test AS is_validation, count(*) AS n FROM flagged GROUP BY label, is_test",
    )
    s["folds"] = _with(
        *LABELLED,
        then="SELECT key, label, (ntile(3) OVER (PARTITION BY label ORDER BY ('0x' || substr(md5(key), 1, 15))::BIGINT, key) - 1)::INT AS fold FROM labelled",
    )
    s["folds_hash"] = _with(
        *LABELLED, then=f"SELECT key, label, (({_hash('key', 'fold')} * 3) >> 32)::INT AS fold FROM labelled"
    )

    s["split_random"] = _with(KEYED, then="SELECT key, count(*) AS times FROM crop GROUP BY key")
    test = f"{_hash('key', '190')} >= {round(0.7 * 2**32)}"
    held_out = f"FROM labelled WHERE {NO_NULL} AND {NOT_TYPE} AND {test}"
    s["train_tree"] = s["train_boosted"] = _with(*LABELLED, then=f"SELECT key, label, label AS predicted_label {held_out}")
    borders = {"B06_p50": "500.0, 1250.5, 2500.0, 4000.0", "B06_sd": "0.25, 0.5, 1.0, 2.5", "NDVI_p50": "100.0, 350.25, 500.0", "VV_p50": "10.0, 40.0"}
    counted = ", ".join(
        f"len(list_filter([{edges}]::DOUBLE[], lambda e: e <= {band}))::INT AS code_{i}" for i, (band, edges) in enumerate(borders.items())
    )
    s["pool_codes"] = _with(
        *LABELLED,
        ("rows", f"SELECT * FROM labelled WHERE {NO_NULL} AND {NOT_TYPE}"),
        then=f"SELECT key, (dense_rank() OVER (ORDER BY label) - 1)::INT AS class_index, {counted} FROM rows",
    )
    s["model_round_trip"] = _with(*LABELLED, then=f"SELECT key, label, true AS same {held_out}")
    # A deeper tree fits more, and the code follows from the first band.
    s["grid_search"] = _with(
        *LABELLED,
        ("counts", f"SELECT label, count(*) AS n FROM labelled WHERE {NO_NULL} AND {NOT_TYPE} AND NOT ({test}) GROUP BY label"),
        ("known", "SELECT max(n)::DOUBLE / sum(n) AS majority FROM counts"),
        then="SELECT position, params, majority, above FROM known, (VALUES (1, 'maxDepth=7', true), (2, 'maxDepth=1', false)) v(position, params, above)",
    )
    s["select_model"] = _with(
        *LABELLED,
        ("rows", f"SELECT label, {test} AS held_out FROM labelled WHERE {NO_NULL} AND {NOT_TYPE}"),
        then="SELECT count(DISTINCT label)::INT AS n_classes, count(*) FILTER (held_out) AS test_rows, "
        "'B06_p50' AS first_band, 'maxDepth=7' AS best FROM rows",
    )
    features = ("groupID", "zoneID", "B06_p50", "B06_sd", "NDVI_p50", "VV_p50")
    alike = " UNION ALL ".join(f"""SELECT '{f}' AS band, ntile(23) OVER (ORDER BY "{f}") AS part, label FROM rows""" for f in features)
    s["importance"] = _with(
        *LABELLED,
        ("rows", f"SELECT * FROM labelled WHERE {NO_NULL} AND {NOT_TYPE} AND NOT ({test})"),
        ("alike", alike),
        ("sizes", "SELECT band, part, label, count(*) AS n FROM alike GROUP BY ALL"),
        ("named", "SELECT band, part, max(n) AS n FROM sizes GROUP BY ALL"),
        ("ranked", "SELECT band, row_number() OVER (ORDER BY sum(n) DESC, band) = 1 AS strongest FROM named GROUP BY band"),
        then="SELECT band, strongest, strongest AS moves_most, true AS in_scale FROM ranked",
    )
    whole = ("wide", fixtures.derive_sql("lineitem", *fixtures.WIDE, (fixtures.KEY, "key")))
    strata = {"type_46000": "= 46000", "type_22000": "= 22000", "type_43000_6000": "IN (43000, 6000)"}
    s["scenario_summary"] = _with(
        whole,
        ("test", f"SELECT * FROM wide WHERE {NO_NULL} AND {test}"),
        (
            "counts",
            " UNION ALL ".join(
                f"SELECT '{c.name}' AS scenario, {SEASON_CASE if c.name == 'season_full' else TYPE_CASE} AS label, count(*) AS n FROM test "
                f"WHERE {NOT_SEASON if c.name == 'season_full' else NOT_TYPE}"
                + (f' AND "groupID" {strata[c.name]}' if c.name in strata else "")
                + " GROUP BY ALL"
                for c in SCENARIOS
            ),
        ),
        then="SELECT scenario, sum(n)::BIGINT AS test_rows, max(n)::DOUBLE / sum(n) AS majority, true AS above FROM counts GROUP BY scenario",
    )

    right = "count(*) FILTER (label = prediction)::DOUBLE / count(*)"
    s["accuracy"] = _with(
        *PREDICTED, then=f"SELECT {right} AS accuracy, 1 - {right} AS test_error FROM predicted"
    )
    s["prf_support"] = _with(*PER_CLASS, then="SELECT * FROM scores")
    s["confusion"] = _with(
        *PREDICTED, then="SELECT label, prediction, count(*) AS n FROM predicted GROUP BY label, prediction"
    )
    s["confusion_matrix"] = _with(
        *PREDICTED,
        then="SELECT label, "
        + ", ".join(f"count(*) FILTER (prediction = '{n}') AS predicted_{n}" for n in TYPE_NAMES)
        + " FROM predicted GROUP BY label",
    )
    s["ranked_importance"] = _with(*BANDS, then="SELECT * FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, band)::INT AS position FROM bands) WHERE importance <> 0")
    s["results_json"] = _with(
        *PER_CLASS,
        ("bands", BANDS[1][1]),
        then=f"SELECT (SELECT {right} FROM predicted) AS accuracy, "
        "(SELECT string_agg(band, ',' ORDER BY importance DESC, band) FROM bands) AS bands, "
        "(SELECT string_agg(support::VARCHAR, ',' ORDER BY class) FROM scores) AS support, "
        '(SELECT list("precision" ORDER BY class)[1] FROM scores) AS first_precision, '
        "(SELECT list(recall ORDER BY class)[2] FROM scores) AS second_recall, "
        "(SELECT list(fscore ORDER BY class)[3] FROM scores) AS third_fscore",
    )
    rank = "row_number() OVER (ORDER BY mean_test_score DESC, params)::INT AS position"
    s["ranked_candidates"] = _with(*GUESSES, then=f"SELECT *, {rank} FROM candidates")
    s["best_candidate"] = _with(
        *GUESSES, then="SELECT *, 1 AS position FROM candidates ORDER BY mean_test_score DESC, params LIMIT 1"
    )

    s["tile_links"] = _links("page", "tion")
    s["tile_links_all"] = _links("'/data/'", "")
    s["epsg_names"] = _with(
        *TILES,
        then="SELECT seq, epsg, zone, zone || '.vrt' AS output, zone || '_EPSG3035.vrt' AS reprojected, "
        "replace(url, '.vrt', '_EPSG3035.vrt') AS tile_output FROM zoned",
    )
    s["zone_groups"] = _with(
        *TILES,
        then="SELECT zone, floor(seq / 1000)::BIGINT AS part, count(*) AS n, string_agg(url, ' ' ORDER BY seq) AS urls "
        "FROM zoned GROUP BY 1, 2",
    )
    known = "FROM zoned WHERE zone <> 'unknown'"
    s["zone_sources"] = _with(*TILES, then=f"SELECT zone, seq, url, xmin, ymax {known}")
    s["zone_mosaic"] = _with(
        *TILES,
        then="SELECT zone, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, "
        f"count(*) AS n_tiles, min(seq) AS first_seq {known} GROUP BY zone",
    )
    corners = " UNION ALL ".join(
        f"SELECT zone, seq, {x} AS x, {y} AS y {known}" for x in ("xmin", "xmax") for y in ("ymin", "ymax")
    )
    s["combined_extent"] = _with(
        *TILES,
        ("corners", corners),
        *_utm_to_laea("corners", "seq"),
        then="SELECT round(min(tx), 3) AS xmin, round(min(ty), 3) AS ymin, round(max(tx), 3) AS xmax, "
        "round(max(ty), 3) AS ymax, count(DISTINCT seq) AS n_tiles FROM moved",
    )
    s["skip_existing"] = _with(
        *TILES,
        then=f"SELECT zone || '.vrt' AS output, zone, count(*) AS n_tiles {known} AND right(zone, 1)::INT % 2 = 1 GROUP BY zone",
    )

    asked = ("asked", fixtures.derive_sql("supplier", *fixtures.WINDOWS))
    s["window_sources"] = _with(
        *TILES, asked,
        then='SELECT a."window", a.zone, z.seq, z.url FROM asked a JOIN zoned z ON z.zone = a.zone '
        "AND z.xmin < a.xmax AND z.xmax > a.xmin AND z.ymin < a.ymax AND z.ymax > a.ymin",
    )
    s["window_pixels"] = _with(
        *PIXELS, asked,
        then='SELECT a."window", a.zone, m.px, m.py, m.value, m.seq FROM asked a JOIN mosaic m ON m.zone = a.zone '
        "AND m.px * 10000 < a.xmax AND (m.px + 1) * 10000 > a.xmin AND m.py * 10000 < a.ymax AND (m.py + 1) * 10000 > a.ymin",
    )
    s["mosaic_pixels"] = _with(*PIXELS, then="SELECT * FROM mosaic")
    s["reproject"] = _with(*MOVED, then="SELECT zone, px, py, round(tx, 3) AS tx, round(ty, 3) AS ty FROM moved")
    projected = [step for step in MOVED[len(PIXELS):] if step[0] not in ("centres", "g1", "g2", "g3", "g4")]
    s["reproject_geographic"] = _with(
        *PIXELS,
        (
            "g4",
            "SELECT zone, 0 AS x, 0 AS y, px, py, value, radians(((py % 3500 + 3500) % 3500) / 100.0::DOUBLE + 35) AS lat, "
            "radians(((px % 4000 + 4000) % 4000) / 100.0::DOUBLE - 10) AS lon FROM mosaic",
        ),
        *projected,
        then="SELECT zone, px, py, round(tx, 3) AS tx, round(ty, 3) AS ty FROM moved",
    )
    s["regrid"] = _with(*REGRID, then="SELECT * FROM regridded")
    s["warp_systems"] = _with(
        ("raw", fixtures.derive_sql("events", *fixtures.MIXED_PIXELS)),
        ("pixels", "SELECT *, replace(replace(srs, ' ', ''), ':', '') AS zone FROM raw WHERE srs <> ''"),
        ("all_cells", PIXELS[2][1]),
        ("mosaic", "SELECT * FROM all_cells WHERE zone <> 'EPSG3035'"),
        *WARP[len(PIXELS):],
        then="SELECT zone, cx, cy, value FROM warped UNION ALL SELECT zone, px, py, value FROM all_cells WHERE zone = 'EPSG3035'",
    )
    s["combine_zones"] = _with(
        *WARP,
        _STACK,
        then="SELECT cx, cy, value FROM warped JOIN stack USING (zone) "
        "QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY zone_seq DESC) = 1",
    )
    s["warp_zones"] = _with(*WARP, then="SELECT * FROM warped")
    cells = (
        "cells",
        "SELECT cx AS px, cy AS py, value FROM warped JOIN stack USING (zone) "
        "QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY zone_seq DESC) = 1",
    )
    top_left = "arg_min(value, py * 1000000 + px)"
    s["staged_resume"] = _with(*WARP, _STACK, cells, then=_pyramid((1, 4, 8), top_left))
    listed = ("pixels", f"{PIXELS[1][1]} AND seq % 3 <> 1")
    s["listed_mosaic"] = _with(PIXELS[0], listed, *WARP[2:], _STACK, cells, then=_pyramid((1, 4, 8), top_left))
    s["overview_pyramid"] = _with(
        *GRID,
        then=_pyramid((32, 64, 128), "arg_min(value, py * 1000000 + px)"),
    )
    s["overview_average"] = _with(*GRID, then=_pyramid((32, 48, 128), "sum(round(value * 100)::BIGINT)::DOUBLE / count(*)"))
    strips = ("strips", "SELECT zone, px, py, value, floor(seq / 2400)::BIGINT AS seq FROM pixels WHERE value IS NOT NULL")
    merged = (
        "merged",
        "SELECT zone, px, py, value, seq FROM strips "
        "QUALIFY row_number() OVER (PARTITION BY zone, px, py ORDER BY seq DESC, value DESC) = 1",
    )
    s["mosaic_blocks"] = _with(*PIXELS[:2], strips, merged, then="SELECT * FROM merged")
    s["block_sizes"] = _with(
        *PIXELS[:2],
        strips,
        then="SELECT zone, floor(px / 32)::BIGINT AS bx, floor(py / 32)::BIGINT AS by, seq, "
        "count(DISTINCT (px, py)) AS n_cells, max(value) AS highest FROM strips GROUP BY 1, 2, 3, 4",
    )
    s["block_overviews"] = s["overview_pyramid"]
    s["block_averages"] = _with(*GRID, then=_pyramid((16, 32, 128), "sum(round(value * 100)::BIGINT)::DOUBLE / count(*)"))
    s["patched_blocks"] = _with(
        *PIXELS[:2],
        strips,
        merged,
        _STACK,
        (
            "remade",
            "SELECT zone, px, py, CASE WHEN zone = 'EPSG32631' THEN value + 1 ELSE value END AS value FROM merged "
            "WHERE zone <> 'EPSG32631' OR floor(py / 16) % 2 = 0",
        ),
        then="SELECT px, py, value, zone_seq AS seq FROM remade JOIN stack USING (zone) "
        "QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY zone_seq DESC) = 1",
    )
    s["publish"] = _with(
        *PIXELS,
        then="SELECT zone, px, py, CASE WHEN zone = 'EPSG32630' THEN value + 1 ELSE value END AS value, seq FROM mosaic",
    )
    return s
