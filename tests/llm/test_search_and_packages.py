"""WARC packages, importance resampling and ranked search against brute force."""

import base64
import collections
import gzip
import hashlib
import io
import json
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldmosaic.llm import ball_tree, queries, resampling, terms, zip_warc
from fieldmosaic.session import new_path

from .conftest import clashing

PAGES = "page_id long, url string, html string"
LONG = "<p>é long</p>" * 200
ROWS = [
    (1, "http://a.example.com/x", LONG), (5, "http://b.example.com/ y\r\n", LONG), (9, None, LONG), (9, "http://c.example.com/", LONG),
    (2, "http://a.example.com/short", "short"), (3, "http://a.example.com/short", "short"), (4, "", None), (6, "no address", ""),
    (None, "http://a.example.com/n", LONG), (None, "http://a.example.com/m", "k" * 1000), (7, "http://d", "z" * 999), (8, "http://d", "z" * 999),
    (10, "http://e", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (11, "http://f", "x" * 300_000),
]


def pages_by_hand(rows, least=1000):
    last = {}
    for key, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least and key is not None:
            last[body] = max(last.get(body, key), key)
    out = []
    for key, _, html in rows:
        body = (html or "").encode()
        again = body in last and (key is None or key < last[body])
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[body] if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


@pytest.mark.parametrize("package", [zip_warc.PACKAGE_BYTES, 500])
def test_pages_come_back(spark, monkeypatch, package):
    monkeypatch.setattr(zip_warc, "PACKAGE_BYTES", package)
    monkeypatch.setattr(zip_warc, "MEMBER_BYTES", 300)
    pages = clashing(spark.createDataFrame(ROWS, PAGES).repartition(3)).withColumns({c: F.lit("x") for c in ("key", "body", "digest", "size", "last", "original")})
    folder = new_path(spark, "warc")
    manifest = zip_warc.write_packages(zip_warc.decided(pages), folder)
    found = zip_warc.entries(manifest)
    got = zip_warc.read_records(found, zip_warc.total_bytes(manifest))
    assert rows_of(got) == pages_by_hand(ROWS)
    bodies = collections.Counter((r.key, bytes(r.payload)) for r in got.where("record_type = 'response'").collect())
    said = collections.Counter((k, (h or "").encode()) for k, _, h in ROWS)
    assert not bodies - said
    assert {r.key: r.url for r in got.collect()}[5] == "http://b.example.com/%20y%0D%0A"
    one = zip_warc.read_records(found.where("url = 'http://a.example.com/short'"), 1)
    assert sorted(r.key for r in one.collect()) == [2, 3]
    assert sum(r.records for r in manifest.collect()) == len(ROWS) and manifest.count() >= (3 if package == 500 else 1)


def test_packages_follow_the_formats(spark):
    manifest = zip_warc.write_packages(zip_warc.decided(spark.createDataFrame(ROWS, PAGES).coalesce(1)), new_path(spark, "warc"))
    (row,) = manifest.collect()
    with zipfile.ZipFile(row.package) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        records = gzip.decompress(z.read("archive/data-00000.warc.gz")).split(b"WARC/1.1\r\nWARC-Type: ")
        lines = z.read("indexes/index.cdxj").decode().splitlines()
    assert collections.Counter(r.split(b"\r\n")[0] for r in records[1:]) >= collections.Counter({b"warcinfo": 1, b"revisit": 3})
    assert lines == sorted(lines) and len(lines) == len(ROWS)
    entry = json.loads(lines[-1].partition("{")[1] + lines[-1].partition("{")[2])
    assert entry["digest"].startswith("sha1:") and entry["filename"] == "data-00000.warc.gz"


def test_no_pages(spark):
    assert zip_warc.round_trip(spark.createDataFrame([], PAGES), new_path(spark, "warc")).count() == 0


def reading(raw):
    return lambda at, n: raw[at : at + n]


def zipped(names, prefix=b"", comment=b"", wide=False, method=zipfile.ZIP_STORED):
    out = io.BytesIO(prefix)
    out.seek(len(prefix))
    with zipfile.ZipFile(out, "a" if prefix else "w", method) as z:
        z.comment = comment
        for name, body in names.items():
            with z.open(name, "w", force_zip64=wide) as m:
                m.write(body)
    return out.getvalue()


@pytest.mark.parametrize("prefix", [b"", b"#! run me\n" * 9])
@pytest.mark.parametrize("comment", [b"", b"PK\5\6 in a comment" * 30])
@pytest.mark.parametrize("wide", [False, True])
def test_directory_of_packages(prefix, comment, wide):
    names = {"a/é.txt": b"one", "archive/x": b"two" * 99, "empty": b""}
    raw = zipped(names, prefix, comment, wide)
    found = list(zip_warc.central_directory(reading(raw), len(raw)))
    assert [m.name for m in found] == list(names)
    for m in found:
        at = zip_warc.stored_at(reading(raw), m)
        assert raw[at : at + m.size] == names[m.name]


def test_directory_beyond_the_short_fields(monkeypatch):
    many = zipped({f"m{i}": b"%d" % i for i in range(66_000)})
    assert b"PK\6\6" in many
    found = list(zip_warc.central_directory(reading(many), len(many)))
    assert len(found) == 66_000
    at = zip_warc.stored_at(reading(many), found[65_999])
    assert many[at : at + 5] == b"65999"
    # sizes and places as eight bytes each, and a long prefix that the locator doesn't know of
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    names = {"x": b"1" * 500, "y": b"2" * 300, "z": b"3"}
    raw = zipped(names, wide=True)
    for shifted in (raw, b"p" * 1234 + raw):
        for m in zip_warc.central_directory(reading(shifted), len(shifted)):
            at = zip_warc.stored_at(reading(shifted), m)
            assert shifted[at : at + m.size] == names[m.name]


def test_what_cannot_be_read_is_an_error():
    packed = zipped({"archive/a.warc.gz": b"x" * 100}, method=zipfile.ZIP_DEFLATED)
    for raw, why in ((packed, "compressed"), (b"no zip" * 10, "not a ZIP"), (b"", "not a ZIP"), (packed[:-30] + packed[-22:], "out of place|ends early|damaged|local header")):
        with pytest.raises(ValueError, match=why):
            list(zip_warc.package_entries(reading(raw), len(raw)))


def test_packages_of_others(spark, tmp_path):
    """An archive without an index is walked; an index in gzip is read."""
    records = [zip_warc._page_record(i, f"http://x/{i}", zip_warc.NO_DATE, b"b%d" % i, hashlib.sha1(b"b%d" % i).hexdigest(), 2, None) for i in range(9)]
    starts = np.cumsum([0, *map(len, records)])
    index = "".join(f"x 1 {json.dumps({'offset': str(starts[i]), 'length': str(len(records[i])), 'filename': 'd.warc.gz'})}\n" for i in range(9))
    for name, more in (("a", {}), ("b", {"indexes/index.cdx.gz": gzip.compress(b"!meta 0 \n") + gzip.compress(index.encode())})):
        path = tmp_path / f"{name}.wacz"
        path.write_bytes(zipped({"archive/d.warc.gz": b"".join(records), **more}))
        manifest = spark.createDataFrame([(f"file://{path}", 1)], "package string, bytes long")
        got = zip_warc.read_records(zip_warc.entries(manifest), 1)
        assert {r.key: bytes(r.payload) for r in got.collect()} == {i: b"b%d" % i for i in range(9)}
    with pytest.raises(ValueError, match="doesn't match"):
        zip_warc._parsed(zip_warc._page_record(1, None, "", b"changed", hashlib.sha1(b"as it was").hexdigest(), 7, None))
    assert base64.b32encode(b"") == b""


# --- resampling ---

ODD = [(1, None), (2, ""), (3, "-- !"), (4, "One"), (5, "é É ß 中文 a"), (6, "w" * 300 + " " + "y" * 65 + " z " + "é" * 40), (7, "A b C " * 50), (8, "A b C " * 50), (-3, "the sea " * 4000)]


def texts(n=120, seed=5):
    rng = random.Random(seed)
    names = ["the", "sea", "and", "Hill", "naïve", "x1", "stone", "q" * 70] + [f"rare{i}" for i in range(300)]
    weights = [40, 20, 20, 10, 5, 5, 5, 1] + [1] * 300
    return [(100 + i, " ".join(rng.choices(names, weights, k=rng.randint(0, 90)))) for i in range(n)]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_words_are_runs_of_word_bytes(text):
    import re

    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text.encode("utf-8", "ignore").decode())
    assert [w.decode() for w in terms.words(lower.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@pytest.mark.parametrize(("rarity", "paired"), [(50_000, 1024), (40, 3), (1, 1)])
def test_resampling_equals_brute_force(spark, documents, monkeypatch, rarity, paired):
    monkeypatch.setattr(resampling, "RARITY", rarity)
    monkeypatch.setattr(resampling, "PAIRED", paired)
    rows, target = [*ODD, *texts()], ["the stone and the sea", None, "A b c", "rare1 rare2"]
    docs = clashing(documents([*rows, (None, "a b " * 30)]))
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, aim).collect()
    # the row without an id counts in all totals, and is scored by nobody
    expected = resampling.brute_force([*rows, (10**9, "a b " * 30)], target)
    for r in got:
        if r.doc_id is None:
            assert (r.n_features, r.weight) == expected[10**9][:2] and r.score is None and r["rank"] is None
        else:
            assert (r.n_features, r.weight, r.score) == expected[r.doc_id][:3]
    able = sorted((-r.score, r.doc_id) for r in got if r.n_words >= 20 and r.score is not None)
    drawn = [i for _, i in able[: 5 * len(able) // 100]]
    assert sorted((r["rank"], r.doc_id) for r in got if r["rank"]) == list(enumerate(drawn, 1)) and len(drawn) >= 4


def test_resampling_of_nothing_and_of_copies(spark, documents):
    aim = spark.createDataFrame([], "text string")
    assert resampling.resample(documents([]), aim).count() == 0
    rows = [(7, "the sea " * 20)] * 60 + [(i, "the sea " * 20) for i in range(100, 140)]
    got = resampling.resample(documents(rows), aim).collect()
    assert len(got) == 100 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]


def test_drawn_of_the_small_table(spark, small, small_documents):
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    expected = resampling.brute_force([(r.doc_id, r.text) for r in small_documents.collect()], target)
    got = queries.op12_resampling(spark, small)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == expected


# --- ranked search ---


@pytest.mark.parametrize(("block", "leaf", "items"), [(8192, 48, 1000), (20, 2, 3)])
def test_ranked_search_equals_brute_force(spark, documents, monkeypatch, block, leaf, items):
    monkeypatch.setattr(ball_tree, "BLOCK_DOCS", block)
    monkeypatch.setattr(ball_tree, "BLOCK_ITEMS", items)
    monkeypatch.setattr(ball_tree.BallTree.__init__, "__defaults__", (leaf,))
    rows = [*ODD, *texts(200), *[(1000 + i, "rare5 rare6 sea stone") for i in range(70)]]
    asked = [(1, "The sea and the hill"), (2, "rare5 RARE6 rare7"), (3, None), (4, "nowhere"), (5, "中文 é"), (6, "x1 " * 9), (7, "q" * 70)]
    table = spark.createDataFrame(asked, "item_id long, text string")
    got = ball_tree.rank(clashing(documents(rows)), clashing(table)).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == sorted(ball_tree.brute_force(rows, asked))


def test_ranked_search_of_ties_nulls_and_nothing(spark, documents):
    asked = spark.createDataFrame([(1, "sea"), (1, "sea"), (None, "hill")], "item_id long, text string")
    rows = [(i % 40, "sea stone") for i in range(80)] + [(None, "sea stone"), (500, "hill"), (501, "stone other"), (502, "other")] + [(600 + i, "other") for i in range(300)]
    got = ball_tree.rank(documents(rows), asked).collect()
    one = sorted((r["rank"], r.doc_id) for r in got if r.item_id == 1)
    assert one[::2] == one[1::2] == [(1, None), *[(2 + i, i // 2) for i in range(49)]]
    assert [(r["rank"], r.doc_id) for r in got if r.item_id is None] == [(1, 500)]
    empty = documents([])
    assert ball_tree.rank(empty, asked).count() == 0 and ball_tree.rank(documents([(1, None)]), asked).count() == 0
    assert ball_tree.rank(documents(rows), asked.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    """No document scores above the bound of a node that holds it, and the search opens few
    leaves where documents fall into far groups."""
    rng = np.random.default_rng(8)
    n, size = 3000, 400
    number = {b"%d" % i: i for i in range(size)}
    groups = rng.integers(0, 20, n)
    rows = [np.sort(rng.choice(20, rng.integers(1, 12), replace=False)) + 20 * g for g in groups]
    lengths = np.array([len(r) for r in rows])
    values = rng.integers(1, 10**6, lengths.sum())
    block = ball_tree.Docs(np.arange(n), np.zeros(n, bool), ball_tree.offsets_of(lengths), np.concatenate(rows), values)
    weights = rng.integers(0, 9000, size)
    scale = np.maximum(weights, 1).astype(float)
    tree = ball_tree.BallTree(block, scale, 10)
    dense = np.zeros((n, size), np.int64)
    dense[np.repeat(np.arange(n), lengths), np.concatenate(rows)] = values
    opened = []
    for _ in range(40):
        terms = np.sort(rng.choice(20, 6, replace=False)) + 20 * rng.integers(0, 20)
        scores = dense[:, terms] @ weights[terms]
        bound = tree.bounds(terms, weights[terms] / scale[terms])
        assert all(scores[tree.order[a:b]].max() <= m for a, b, m in zip(tree.low, tree.high, bound, strict=True))
        best = ball_tree.Best(50).over(block.ids, block.nulls)
        opened.append(tree.search(terms, weights[terms] / scale[terms], weights, best, np.zeros(size, np.int64)))
        right = sorted((-int(s), True, i) for i, s in enumerate(scores) if s > 0)[:50]
        assert best.rows == right
    assert len(number) == size and np.mean(opened) < 0.25 * sum(c < 0 for c in tree.left)
