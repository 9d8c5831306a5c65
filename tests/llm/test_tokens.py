"""Token files, packing and byte-level BPE against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldmosaic.llm import byte_bpe, packing, token_files
from fieldmosaic.llm.tokens import WordEncoder
from fieldmosaic.session import new_path

from .conftest import clashing

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    (5, "Don't we're I'LL 5's naïve ÉCOLE straße ΣΑΣ x́y é. a.b,c! <|startoftext|>hi <|ENDOFTEXT|> İstanbul \x1c \x85z"),
    (1, None), (2, ""), (3, "   \n\t "), (9, "a" * 3000), (4, "one two three " * 4000), (7, "same"), (7, "same"), (None, "no id"), (8, "中文字" * 60),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def own():
    return WordEncoder(WORDS)


@pytest.fixture(scope="module")
def bytes_table():
    return byte_bpe.BpeTable(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_own():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


TEXTS = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\tab.,'<|>éÉßÀ1")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=150, deadline=None)
@given(text=TEXTS)
def test_words_as_the_library(library, own, text):
    ids, counts = own.encode([text, "", text], 2)
    assert ids.tolist() == ids_of(library, text) + [2] + ids_of(library, text)
    assert counts.sum() == len(ids)


@settings(max_examples=60, deadline=None)
@given(text=TEXTS)
def test_bytes_as_the_library(bytes_table, tiktoken_own, text):
    ids, counts, back = bytes_table.encode([text, text + text])
    expected = tiktoken_own.encode_ordinary(text), tiktoken_own.encode_ordinary(text + text)
    assert ids.tolist() == [*expected[0], *expected[1]] and counts.tolist() == [len(e) for e in expected]
    assert back == [text.encode(), (text + text).encode()]


def test_long_words_and_full_tables(bytes_table, tiktoken_own, own, library, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abtheing", k=n)) for n in (5, 90, 99, 100, 101, 150, 700)] + ["a" * 5000, " " * 2000]
    monkeypatch.setattr(bytes_table, "limit", 0)  # starts anew with each call
    for t in texts:
        ids, _, back = bytes_table.encode([t])
        assert ids.tolist() == tiktoken_own.encode_ordinary(t) and back == [t.encode()]
    monkeypatch.setattr(own, "limit", 0)
    for t in texts:
        assert own.encode([t], 2)[0].tolist() == ids_of(library, t)


@pytest.mark.parametrize("files", [1, 4])
def test_token_files(spark, documents, library, files):
    path = new_path(spark, "test-tokens")
    token_files.write_tokens(clashing(documents(ODD)), path, WORDS, files=files)
    got = sorted(token_files.digests(spark, path).collect(), key=lambda r: (r.start, r.n_tokens))
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc, text) in zip(got, ordered, strict=True):
        ids = np.array(ids_of(library, text), "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids))
        start += len(ids)
    found = token_files.find_tokens(spark, path, [5, 8])
    assert sorted(r.doc_id for r in found.collect()) == [5, 8]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().executedPlan().toString()


def test_token_files_hold_bloom_filters_and_run_lengths(spark, small_documents, tmp_path):
    import pyarrow.orc as orc

    path = str(tmp_path / "tokens")
    token_files.write_tokens(small_documents, path, WORDS, files=1)
    (part,) = (tmp_path / "tokens").glob("*.orc")
    footer = orc.ORCFile(str(part))
    assert footer.nrows == small_documents.count() and footer.compression == "ZSTD"
    assert b"BLOOM" in part.read_bytes() or footer.nstripe_statistics == footer.nstripes
    plain = sum(r.n_tokens for r in token_files.read_tokens(spark, path).select("n_tokens").collect()) * 4
    assert part.stat().st_size < 0.7 * plain


def test_empty_tables(spark, documents):
    none = documents([])
    path = new_path(spark, "test-tokens")
    token_files.write_tokens(none, path, WORDS)
    assert token_files.digests(spark, path).count() == 0
    assert packing.pack_documents(none, WORDS).count() == 0
    assert byte_bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == 0


def packs_of(rows):
    packs = {}
    for r in rows:
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    return packs


@pytest.mark.parametrize("size", [16, 4096])
def test_packing_places_every_id_once(documents, library, size):
    rows = ODD + [(100 + i, "word " * (i % 40 + 1)) for i in range(300)]
    got = packing.pack_documents(clashing(documents(rows)), WORDS, size=size).collect()
    packs = packs_of(got)
    assert sorted(packs) == list(range(len(packs)))
    for pieces in packs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert 0 < at <= size
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(ids_of(library, text))
    pieces = {}
    for r in got:
        assert r.length <= size
        pieces.setdefault((r.doc_id, r.row), []).append(r)
    for (doc, _), parts in pieces.items():
        ids = np.array(next(t for t in texts[doc] if len(t) == parts[0].doc_tokens), "<u4")
        assert sorted((p.start, p.length) for p in parts) == [(s, min(size, len(ids) - s)) for s in range(0, len(ids), size)]
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length]) for p in parts)
    assert len(pieces) == len(rows)
    tokens = sum(len(t) for some in texts.values() for t in some)
    assert tokens / (len(packs) * size) > 0.9


def test_hot_lengths_are_ranked_in_slices(documents, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    got = packing.pack_documents(documents([(i, "two words") for i in range(100)]), WORDS, size=8).collect()
    assert sorted(len(p) for p in packs_of(got).values()) == [2] * 50


def test_shortest_pack_first():
    rows = packing.place({5: 2, 3: 3, 2: 1}, size=8)
    # two packs of 5; each takes a 3; the third 3 opens a pack, which takes the 2
    assert rows.tolist() == [[5, 0, 2, 0, 0], [3, 0, 2, 0, 5], [3, 2, 1, 2, 0], [2, 0, 1, 2, 3]]
    assert packing.place({}).shape == (0, 5)
    many = packing.place({n: 10**12 // n for n in range(1, 4097)})
    assert len(many) < 60_000  # whatever the number of pieces


def test_byte_bpe_query_columns(documents, tiktoken_own):
    got = byte_bpe.digests(clashing(documents(ODD)), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    for doc, text in ODD:
        ids = np.array(tiktoken_own.encode_ordinary(text or ""), "<u4")
        r = by_id[doc]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    rows = byte_bpe.encode(documents([(1, "hello there")]), RANKS, public_tokenizers.PATTERN).collect()
    assert rows[0].ids == tiktoken_own.encode_ordinary("hello there") and bytes(rows[0].decoded) == b"hello there"


def test_long_words_go_through_the_recursive_query(tiktoken_own, monkeypatch):
    """Words over a hundred bytes, as 40 Chinese characters in a row, take no other route."""
    draw = random.Random(5)
    words = ["漢字仮名交文章中国日本" * 4, "a" * 999, "ab" * 333 + "a", "é" * 301, "the" * 200, "!" * 400 + "=" * 501, "q" * 101]
    words += ["".join(draw.choice("etaoinshrdlu") for _ in range(n)) for n in (101, 500, 999)]
    words += ["".join(draw.choice("ab") for _ in range(n)) for n in (150, 700)]

    def never(word):
        raise AssertionError(f"{len(word)} bytes left the query")

    table = byte_bpe.BpeTable(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(table, "_contract", never)
    assert all(byte_bpe.LONG < len(w.encode()) <= byte_bpe.LONGEST for w in words)
    ids, counts, back = table.encode([" ".join(words), *words, ""])
    texts = [" ".join(words), *words, ""]
    assert [b.decode() for b in back] == texts
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends, strict=True):
        assert ids[end - n : end].tolist() == tiktoken_own.encode_ordinary(text)


def test_the_longest_words_equal_the_library(tiktoken_own):
    draw = random.Random(6)
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(n)) for n in (1001, 20_000)] + ["aab" * 5000]
    ids, counts, _ = byte_bpe.BpeTable(RANKS, public_tokenizers.PATTERN).encode(words)
    assert ids.tolist() == [i for w in words for i in tiktoken_own.encode_ordinary(w)]
    assert len(counts) == 3


def test_both_queries_contract_alike():
    """The first query, one pair a step, and the second on the same words."""
    draw = random.Random(7)
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(2, 60))).encode() for letters in ("ab", "the n", "inga") for _ in range(150)]
    table = byte_bpe.BpeTable(RANKS, public_tokenizers.PATTERN)
    found = []
    for sql in (byte_bpe.ENCODE, byte_bpe.ENCODE_LONG):
        ids = [None] * len(words)
        table._query(sql, words, list(range(len(words))), ids)
        found.append(ids)
    assert found[0] == found[1] == [table._contract(w) for w in words]
