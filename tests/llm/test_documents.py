"""Operators on whole documents against brute force."""

import collections
import datetime
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmosaic.llm import boosted_quality, components, fingerprints, line_dedup, ngram_join, quality_rules, toxicity, url_lists
from fieldmosaic.llm.labelled import remainder

from .conftest import clashing

VOID = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(3000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "ONE two  three\nfour"), (7, LONG), (8, LONG + " tail"),
    (9, "the same line\n" * 40), (9, "the same line\n" * 40), (10, "a b c d e f g h " * 5 + "é ß 中 #*$ &|<>"), (None, LONG), (11, "x " * 25),
]


def near_copies(seed=3, families=4, members=14, words=60):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(words)]
        for m in range(members):
            text = list(base)
            for at in rng.integers(0, words, rng.integers(0, 4)):
                text[at] = f"edit{rng.integers(10**6)}"
            rows.append((10_000 + 1000 * f + m * 7, " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_ngram_join_equals_brute_force(documents, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = [r for r in ODD if r[0] is not None] + near_copies()
    expected = ngram_join.brute_force(dict(rows))
    got = ngram_join.join(clashing(documents([*rows, (None, LONG)]))).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 2996
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id], r


def test_ngram_join_of_the_small_table(spark, small, small_documents):
    expected = ngram_join.brute_force({r.doc_id: r.text for r in small_documents.collect()})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(small_documents).collect()}
    assert got == expected


def test_ngram_join_of_nothing_and_of_double_ids(documents):
    assert ngram_join.join(documents([])).count() == 0
    one, two = " ".join("abcdefgh"), " ".join("stuvwxyz")
    got = {r.doc_id: r.component_id for r in ngram_join.join(documents([(3, one), (5, one), (5, two), (7, two), (9, "z")])).collect()}
    assert got == {3: 3, 5: 3, 7: 3, 9: 9}
    kept = ngram_join.keep_one(documents([(3, one), (5, one), (7, two), (None, one), (8, None)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 3), (False, 7), (False, 8), (True, 0)]


def test_bound_of_first_tokens_loses_no_link():
    """For all sizes: two sets at the limit have as many first tokens in common as asked."""
    for n, s in itertools.product(range(1, 60), range(1, 60)):
        overlap = next((o for o in range(min(n, s) + 1) if 100 * o >= 80 * (n + s - o)), None)
        if overlap is None:
            continue
        rest = max((4 * n + 4) // 5, (4 * s + 4) // 5) - 1
        asked = max(1, (4 * (n + s) + 8) // 9 - max((4 * n + 4) // 5, (4 * s + 4) // 5))
        assert asked <= max(1, overlap - rest)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(501, 580)] + [(7, 7), (900, 800), (800, 900)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 500 for i in range(501, 580)}, 900: 800}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def counts_of(text):
    words = VOID.findall(text or "")
    found = collections.defaultdict(list)
    for i in range(len(words) - 7):
        found[tuple(words[i : i + 8])].append(i)
    repeated = {p for at in found.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if VOID.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_equal_brute_force(documents):
    rows = [*ODD, (20, "u v w x y z a b c " * 3 + LONG), (21, "q " * 8 + "r " * 8), (22, "1 2 3 4 5 6 7 8 9")]
    got = quality_rules.apply_rules(clashing(documents(rows))).collect()
    assert len(got) == len(rows)
    by_id = collections.defaultdict(list)
    for doc, text in rows:
        by_id[doc].append(counts_of(text))
    for r in got:
        n, chars, symbols, lines, repeated = (r[c] for c in quality_rules.BASE)
        assert (n, chars, symbols, lines, repeated) in by_id[r.doc_id], r
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n) and (not r.kept or not r.base_failed)


def jensen_shannon(p, q):
    m = (p + q) / 2

    def terms(x):
        return float(sum(v * np.log2(v) for v in x if v > 0))

    return max(0.0, (terms(p) + terms(q)) / 2 - terms(m)) ** 0.5


def test_distances_and_verdicts(spark, documents):
    plain = " ".join(["the", "of", "sun", "and", "rain", "the", "sea"] * 1)
    rows = [(i, " ".join(f"{plain} {chr(97 + i % 26)}{k}" for k in range(20)).translate(str.maketrans("0123456789", "abcdefghij"))) for i in range(40)]
    rows.append((99, " ".join(f"{w.upper()}!!{i}$$$" for i, w in enumerate(["the", "of", "sun"] * 40))))
    docs = documents(rows)
    refs = quality_rules.references(docs)
    shares = [r.classes for r in refs.collect()]
    got = {r.doc_id: r for r in quality_rules.judge(docs, refs).collect()}
    assert not got[99].kept and all(got[i].kept for i in range(40))
    counts = docs.select("doc_id", quality_rules.class_counts(F.col("text"), quality_rules.rest_of(F.col("text")), F.length(F.regexp_replace("text", r"\s", ""))).alias("c"))
    for r in counts.collect():
        p = np.array(r.c) / sum(r.c)
        expected = min(jensen_shannon(p, np.array(q)) for q in shares)
        assert sum(r.c) == len(dict(rows)[r.doc_id]) and got[r.doc_id].class_distance == pytest.approx(expected, abs=1e-9)


def test_quality_of_nothing_and_without_languages(documents):
    assert quality_rules.apply_rules(documents([])).count() == 0
    docs = documents([(1, LONG), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id: r.kept for r in quality_rules.apply_rules(docs).collect()} == {1: True, 2: False}


def test_every_language_has_its_reference(documents):
    """Forty languages, each in letters and words of its own; rows without a language are
    judged by their words, a broken row of the 18th language goes, and one of the smallest,
    which has too little text to tell, stays."""
    rows, langs = [], {}
    for k in range(40):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(30)] if k % 2 else [f"{chr(97 + k % 26)}{chr(97 + i % 26)}{chr(97 + k // 26)}" for i in range(30)]
        for j in range(45 - k):
            drawn = np.random.default_rng(100 * k + j).integers(5, 30, 60)
            text = " ".join(f"{letters[i % 5]} {letters[at]}" for i, at in enumerate(drawn))
            rows.append((100 * k + j, text))
            langs[100 * k + j] = None if j == 1 else f"l{k:02}"
    broken = " ".join(f"{'ABC'[i % 3]}{i}!!" for i in range(120))
    rows += [(5000, broken), (5001, broken)]
    langs |= {5000: "l17", 5001: "l39"}
    named = F.create_map(*[F.lit(x) for pair in langs.items() for x in pair])[F.col("doc_id").cast("int")]
    docs = clashing(documents(rows).withColumn("lang", named))
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert len(got) == len(rows) and {d for d, r in got.items() if not r.kept} == {5000}
    assert all((r.class_distance is not None and r.common_distance is not None) == (d < 2800) for d, r in got.items() if d < 5000)


def dedup_by_hand(rows):
    lines = {doc: text.split("\n") for doc, text in rows if text is not None}
    seen, gone = set(), set()
    for doc in sorted(lines):
        for i in range(len(lines[doc]) - 2):
            window = tuple(lines[doc][i : i + 3])
            if not VOID.search("".join(window)):
                continue
            if window in seen:
                gone.update((doc, i + k) for k in range(3))
            seen.add(window)
    return {doc: "\n".join(x for i, x in enumerate(some) if (doc, i) not in gone) for doc, some in lines.items()}


def test_line_dedup_equals_brute_force(documents):
    rng = np.random.default_rng(1)
    rows = [(int(i), "\n".join(f"line {k}" for k in rng.integers(0, 4, rng.integers(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n\n"), (103, "a\nb"), (104, "a\nb"), (105, "x\n" * 500), (-5, "line 0\nline 1\nline 2")]
    expected = dedup_by_hand(rows)
    got = line_dedup.remove_repeats(clashing(documents(rows)).drop("n_lines")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        assert r.text == expected.get(r.doc_id), r
        assert r.n_lines == (0 if text is None else len(text.split("\n")))
        assert r.n_lines - r.n_removed == (0 if not r.n_lines - r.n_removed else len(r.text.split("\n")))


def test_line_dedup_of_repeated_rows(documents):
    text = "p\nq\nr\ns"
    got = line_dedup.remove_repeats(documents([(1, text), (1, text), (2, text), (None, "p\nq\nr")])).collect()
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.text)
    # the row without an id comes first and keeps its lines
    assert by_id == {None: {"p\nq\nr"}, 1: {""}, 2: {""}} or by_id == {None: {"p\nq\nr"}, 1: {"s"}, 2: {""}}
    assert line_dedup.remove_repeats(documents([])).count() == 0


def test_parsing_is_locally_consistent():
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdefgh "), 4000))

    def names(text, level):
        codes = np.array([ord(c) for c in text], np.uint64)
        first = np.zeros(len(codes), bool)
        first[0] = True
        for _ in range(level):
            codes, first = fingerprints.parse(codes, first)
        return codes

    for shift in (1, 2, 3, 17):
        a, b = names(passage, 3), names("z" * shift + "".join(rng.choice(list("xyz"), 50)) + passage, 3)
        assert len(set(a) & set(b)) > 0.9 * len(set(a))
    assert 2 < len(passage) / len(names(passage, 1)) < 5
    runs = names("a" * 1000 + "b" * 1000, 1)
    assert len(runs) <= 2


def test_fingerprints_of_neighbours(documents):
    rows = [(i, t) for i, t in ODD if i is not None and i != 9] + [(i, f"document {i} " + LONG[i * 50 : i * 50 + 900]) for i in range(20, 60)]
    got = {r.doc_id: r for r in fingerprints.neighbours(clashing(documents(rows, 5))).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        changed = fingerprints.edited(text, after)
        r = got[i]
        assert len(changed) <= len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own, new, following = fingerprints.sketches([text, changed, after])
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.text_of(own), fingerprints.text_of(new))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, new), fingerprints.likeness(own, following))
    assert got[20].near_edited > 0.15
    single = fingerprints.neighbours(documents([(1, "alone here")])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    assert fingerprints.neighbours(documents([])).count() == 0
    assert fingerprints.neighbours(documents([(9, "x"), (9, "x"), (None, "y")])).count() == 3
    plain = fingerprints.fingerprint(documents(ODD)).collect()
    assert len(plain) == len(ODD) and len({r.fingerprint for r in plain if r.doc_id == 9}) == 1


def test_near_copies_of_any_length_are_alike():
    rng = np.random.default_rng(4)
    letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 2000)
    texts = ["".join(letters[:n]) for n in range(60, 900)]
    found = fingerprints.sketches(texts)
    # copies that differ by their last three characters, on both sides of every limit
    assert min(fingerprints.likeness(a, b) for a, b in zip(found, found[3:])) > 0.6
    assert max(fingerprints.likeness(a, b) for a, b in zip(found, fingerprints.sketches(["".join(rng.permutation(list(t))) for t in texts]))) < 0.5
    assert all(len(s) == fingerprints.LEVEL and all(len(x) <= fingerprints.KEPT for x in s) for s in found)


def test_edited_takes_what_the_next_document_has():
    assert fingerprints.edited("abcdef", "xy") == "abcxy" and fingerprints.edited("abcde", "xyz") == "abcxy"
    assert fingerprints.edited("", "x") == "" and fingerprints.edited("é", "x") == "é"


def test_boosted_trees_find_a_rule_and_flat_scoring_equals_walking():
    rng = np.random.default_rng(4)
    rows = rng.random((2000, 5))
    labels = ((rows[:, 1] > 0.4) ^ (rows[:, 3] > 0.7)).astype(float)
    trees = boosted_quality.fit(rows[:1500], labels[:1500], trees=30, depth=3)
    scores = trees.score(rows[1500:])
    assert ((scores > 0.5) == labels[1500:]).mean() > 0.97
    for row, score in zip(rows[1500:1520], scores, strict=False):
        total = trees.base
        for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert set(boosted_quality.fit(rows, np.ones(2000)).score(rows)) == {2001 / 2002}
    assert boosted_quality.fit(rows[:0], labels[:0]).score(rows)[0] == 0.5


def labelled(rows, name):
    return [(i, int(v)) for i, v in rows], f"doc_id long, {name} int"


def test_quality_classifier_learns_held_out_rows(spark, documents):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = rng.choice(["the", "sun", "rose", "over", "hills", "and", "sea"], 40)
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words[:8]] * 5)))
        labels.append((i, int(good)))
    docs, table = documents(rows + [(1000, None), (1001, "")]), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int")
    trees = boosted_quality.train(docs, table, remainder(4) != 2, rows=200)
    got = {r.doc_id: r.score for r in boosted_quality.score(clashing(docs), trees).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == bool(v) for i, v in labels]) > 0.98
    none = boosted_quality.train(docs, table.limit(0), remainder(4) != 2)
    assert {r.score for r in boosted_quality.score(docs, none).collect()} == {0.5}
    assert boosted_quality.score(documents([]), trees).count() == 0
    few = boosted_quality.sample(docs, table, "quality", remainder(4) != 2, 50)
    assert 20 < few.count() < 90


@pytest.fixture(scope="module")
def decoder(spark, documents):
    text = "what an idiot and a moron wrote this stupid worthless trash, said the pathetic loser to the clown. " * 20
    return toxicity.Decoder(toxicity.costs(toxicity.trigrams(documents([(1, text), (2, None), (3, "plain words of the sea " * 50)]))))


@pytest.mark.parametrize(
    "run,word",
    [("1d10t", "idiot"), ("m0r0n", "moron"), ("tr4sh!!", "trash"), ("t.r.a.s.h", "trash"), ("idiiiiot", "idiot"), ("w0rthle$s", "worthless"), ("l0s3r", "loser"), ("cl*wn", "clown")],
)
def test_disguised_words_are_restored(decoder, run, word):
    assert word in decoder.in_run(run)


def test_single_characters_are_joined(decoder):
    assert "idiot" in decoder.in_singles("such an i d i o t he is".split())
    assert "moron" in decoder.in_singles("m 0 r 0 n".split())
    assert decoder.in_singles("plain words here".split()) == [] and decoder.in_run("plain") == ["plain"]


@pytest.mark.parametrize("run,word", [("$tupid", "stupid"), ("($tupid!", "stupid"), ("m0r0n!!", "moron"), ("1d107", "idiot"), ("*7r45h*", "trash"), ("$.t.u.p.1.d", "stupid")])
def test_disguise_at_the_ends_of_a_run(decoder, run, word):
    assert word in decoder.in_run(run)


def test_rows_of_single_characters_are_cut_into_words(decoder):
    words = "what an idiot and a moron wrote this stupid worthless trash said the pathetic loser to the clown".split()
    features = {f for w in decoder.in_singles(list("youstupididiot")) for f in toxicity.word_features(w)}
    assert {"^stupid", "^idiot"} <= features
    assert {"idiot", "moron", "worthless", "trash", "clown"} <= set(decoder.in_singles(list("".join(words))))
    assert {"stupid", "moron"} <= set(decoder.in_run("-".join("thisstupidmoron" * 5)))
    long = decoder.in_singles(list("idiot" * 4000))
    assert "idiot" in long and len(decoder.decode("1d10t" * 4000, False)) >= 4000


def test_toxicity_learns_and_sees_through_disguise(spark, documents):
    rng = np.random.default_rng(6)
    clean = ["sea", "sun", "hill", "river", "stone", "cloud", "road", "tree", "house", "bird"]
    rows, labels = [], []
    for i in range(500):
        words = list(rng.choice(clean, 30)) + [f"only{'abcdefghij'[int(c)]}{'klmnopqrst'[int(c)]}" for c in str(i)]
        toxic = i % 4 == 0
        if toxic:
            words[int(rng.integers(0, 30))] = str(rng.choice(["moron", "idiot"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    hidden = [(600, "sea sun m0r0n hill"), (601, "the i d i o t sea"), (602, "sea sun hill"), (603, None), (604, ""), (605, "sea " * 20000 + "moron")]
    docs = documents(rows + hidden)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, table, remainder(5) != 0)
    got = {r.doc_id: r.score for r in toxicity.score(clashing(docs).drop("score"), model).collect()}
    assert len(got) == 506 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == bool(v) for i, v in labels)
    assert [got[i] >= 0.5 for i in range(600, 606)] == [True, True, False, False, False, True]
    none = toxicity.train(docs, table.limit(0), remainder(5) != 0)
    assert len({r.score for r in toxicity.score(docs, none).collect()}) == 1
    assert toxicity.score(documents([]), model).count() == 0


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


ENTRIES = [
    ("ads", "host", "Bad.example.com", "add", day(10)), ("ads", "host", "bad.example.com", "remove", day(20)), ("ads", "host", "bad.example.com", "add", day(30)),
    ("ads", "host", "bad.example.com", "add", day(35)), ("mal", "domain", "evil.org", "add", day(0)), ("mal", "domain", "evil.org", "add", day(50)),
    ("mal", "domain", "evil.org", "remove", day(50)), ("spam", "prefix", "shop.net/Buy/now", "add", day(5)), ("spam", "host", "late.com", "remove", day(1)),
    ("ads", "host", None, "add", day(1)), ("ads", "host", "undated.com", "add", None),
]
CAPTURES = [
    ("http://bad.example.com/x", 9, "", False), ("http://bad.example.com/x", 10, "ads", True), ("http://BAD.example.com:80/", 19, "ads", True),
    ("http://bad.example.com", 20, "", False), ("https://u:p@bad.example.com./q?x", 40, "ads", True), ("http://a.b.evil.org/", 3, "mal", True),
    ("http://evil.org/", 49, "mal", True), ("http://evil.org/", 50, "", False), ("http://notevil.org/", 3, "", False),
    ("http://shop.net/Buy/now/7?q#f", 6, "spam", True), ("http://shop.net/buy/now/7", 6, "", False), ("http://shop.net/Buy/nowhere", 6, "", False),
    ("http://late.com/", 6, "", False), (None, 6, "", None), ("no url", 6, "", None), ("http://evil.org/", None, "", None), ("http://undated.com/", 6, "", False),
]


def test_url_lists_as_of_the_fetch(spark):
    entries = spark.createDataFrame(ENTRIES, "list string, kind string, pattern string, action string, day date")
    rows = [(i, u, None if d is None else datetime.datetime.combine(day(d), datetime.time(13))) for i, (u, d, _, _) in enumerate(CAPTURES)]
    captures = spark.createDataFrame(rows + rows[:3], "page_id long, url string, fetch_time timestamp").withColumn("lists", F.lit("x"))
    got = url_lists.evaluate(clashing(captures), entries.union(entries), "page_id").collect()
    assert len(got) == len(CAPTURES) + 3
    for r in got:
        _, _, lists, blocked = CAPTURES[r.page_id]
        assert (r.lists, r.blocked, r.n_matches) == (lists, blocked, int(bool(blocked))), r
    assert {r.since for r in got if r.page_id == 4} == {day(30)}
    assert url_lists.evaluate(captures.limit(0), entries, "page_id").count() == 0
    assert not any(r.blocked for r in url_lists.evaluate(captures, entries.limit(0), "page_id").collect())
    with pytest.raises(Exception, match="unknown kind or action"):
        url_lists.evaluate(captures, entries.withColumn("action", F.lit("block")), "page_id").collect()


def test_texts_of_one_id_keep_their_lines(documents):
    """Different texts under one id are different documents: no line is lost that stands
    nowhere else, and equal rows come back alike."""
    rows = [(1, "p\nq\nr\ns"), (0, "z\ny\nx\nw\nv"), (0, "y\nx\nw"), (0, "y\nx\nw"), (None, "y\nx\nw\nk"), (None, "q\nr\ns\nt")]
    got = collections.Counter((r.doc_id, r.text) for r in line_dedup.remove_repeats(documents(rows)).collect())
    held = {line for _, t in got for line in t.split("\n")}
    assert {line for _, t in rows for line in t.split("\n")} <= held
    assert sum(got.values()) == len(rows)
    assert got[None, "y\nx\nw\nk"] == 1 and got[1, "p"] == 1  # rows without an id come first


def test_one_row_of_each_text_stays(documents):
    text, other = " ".join("abcdefgh"), " ".join("stuvwxyz")
    kept = ngram_join.keep_one(clashing(documents([(1, text), (1, text), (None, other), (None, other), (4, text), (5, "a b")]))).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", text), ("5", "a b"), ("None", other)]


def test_patterns_of_any_length(spark):
    host = ".".join(["long" * 10] * 8)
    deep = "deep.com/" + "/".join(f"s{i}" for i in range(20))
    entries = spark.createDataFrame([("a", "domain", host.partition(".")[2], "add", day(0)), ("b", "prefix", deep, "add", day(0))], "list string, kind string, pattern string, action string, day date")
    rows = [(1, f"http://{host}/x"), (2, f"http://{deep}/more?q"), (3, f"http://{deep}".rpartition("/")[0]), (4, "http://x.com/")]
    table = spark.createDataFrame([(i, u, datetime.datetime(2024, 2, 1)) for i, u in rows], "id long, url string, fetch_time timestamp")
    got = {r.id: r.lists for r in url_lists.evaluate(clashing(table), entries, "id").collect()}
    assert len(host) > 253 and got == {1: "a", 2: "b", 3: "", 4: ""}


@pytest.mark.parametrize("run", ["iddiot", "id-iot", "id.iot", "id​iot", "іdiоt", "1d-10t", "idi_ot"])
def test_small_disguises(decoder, run):
    assert "idiot" in decoder.in_run(run)


def test_dotted_rows_and_families(decoder):
    assert "idiot" in decoder.in_singles("i. d. i. o. t. and".split())
    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(300)]
    plain = [" ".join(["the", *rng.choice(names, 80)]) for _ in range(300)]
    assert len({toxicity._family(t) for t in plain}) == 300
    assert toxicity._family(plain[0]) == toxicity._family(plain[0].upper())
    assert toxicity._family("") == toxicity._family(" ") and toxicity._family("a") != toxicity._family("b")


def test_viterbi_equals_an_exhaustive_search(decoder):
    """Short lattices: every path is spelled out and the likeliest one is the reading."""
    rng = np.random.default_rng(7)
    for _ in range(25):
        run = "".join(rng.choice(list("aio0134$@t."), 4))
        paths = []
        for choice in itertools.product(*decoder._readings(run, False)):
            spent, a, b, word = 0.0, 0, 0, ""
            for code, extra in choice:
                spent += extra
                if code:
                    spent += float(decoder.cost[a, b, code])
                    a, b, word = b, code, word + toxicity.ALPHABET[code - 1]
            paths.append((spent + float(decoder.cost[a, b, 0]), word))
        assert decoder._decode(run, False) in {w for s, w in paths if s <= min(paths)[0] + 1e-6}


def test_plain_words_take_no_reading_apart(monkeypatch):
    """Words of Latin letters with punctuation around them are known without their cores, by the
    same words; runs that mean nothing are looked at once and then left out at once."""
    cost = np.zeros((toxicity._A,) * 3, np.float32)
    expected = {"plain,": {"plain"}, '"sea.': {"sea"}, "aa": {"aa"}, "-ball-": {"ball", "bal"}, "the;": {"the"}, "wooord": None}
    precision = {"=mud": 0.9, "^slim": 0.8, "^slime": 0.85}
    slow = toxicity.Scorer(toxicity.Model(cost, precision, 0.1))
    assert slow._strongest(["slimes", "mud", "slim"]) == (0.9, "mud") and slow._strongest(["slimes", "slip"]) == (0.85, "slimes")

    def never(run):
        raise AssertionError(run)

    monkeypatch.setattr(toxicity, "_cores", never)
    decoder = toxicity.Decoder(cost)
    for run, words in expected.items():
        got = set(decoder.in_run(run))
        assert got == words if words else {"wooord", "wood" if "wood" in got else "woord"} <= got
    scorer = toxicity.Scorer(toxicity.Model(cost, precision, 0.1))
    first = scorer.score("Plain sea, plain mud.")
    monkeypatch.setattr(toxicity.Decoder, "in_run", lambda self, run: never(run))
    assert first == scorer.score("Plain sea, plain mud.") == 1 - 0.9 * (1 - 0.9)
    assert scorer.plain == {"plain", "sea,"}
