import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm.bpe import PATTERN, encoder, have_vocabularies, load_ranks, merge_bytes, token_ids
from loam.llm.pack import best_fit_decreasing, cuts, pack
from loam.llm.split import spans, split_oversized

needs = pytest.mark.skipif(not have_vocabularies(), reason="no vocabulary files")


@given(st.text(alphabet="ab .\ńé", max_size=400), st.integers(5, 60), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_spans_cover_and_fit(text, limit, overlap):
    parts = spans(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(b - a <= limit for a, b in parts)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert a < c <= b < d


def test_spans_end_at_sentences_and_overlap():
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    parts = spans(text, 300, 40)
    assert all(text[b - 1] == "." for _, b in parts)
    assert all(40 <= b - c <= 60 for (_, b), (c, _) in zip(parts, parts[1:]))


def test_split_table(spark):
    chunks = spark.createDataFrame(
        [(1, "md", "A", "x " * 40, 0), (1, "md", "A", "x " * 40, 1), (2, "md", None, "short", 0), (3, None, "", "y" * 99, 0), (4, "md", "B", None, 0), (5, "md", "", "y" * 45, 0)],
        "chunk_id BIGINT, file_type STRING, location STRING, text STRING, n_pieces INT",
    )
    limits = spark.createDataFrame([("md", 20, 5), ("md", 30, 5), ("txt", None, 1)], "file_type STRING, max_chars BIGINT, overlap_chars BIGINT")
    rows = split_oversized(chunks, limits).collect()
    assert {r.chunk_id for r in rows} == {1, 5}
    assert all(len(r.text) <= 20 for r in rows)
    assert len({(r.chunk_id, r.location) for r in rows}) == len(rows)
    assert {r.chunk_id for r in split_oversized(chunks, limits, keep_whole=True).collect()} == {1, 2, 3, 4, 5}
    assert split_oversized(chunks.limit(0), limits).count() == 0
    assert split_oversized(chunks, limits.limit(0)).count() == 0


@needs
def test_merges_equal_a_public_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = load_ranks("byte_bpe_50k")
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = encoder("byte_bpe_50k")
    rng = np.random.default_rng(0)
    letters = list("abcdetioun  \n'sтест🔧é<|endoftext|>​　")
    for _ in range(500):
        text = "".join(rng.choice(letters, rng.integers(0, 80)))
        assert mine(text) == other.encode_ordinary(text)
    assert merge_bytes(b"a" * 3000, ranks) == other.encode_ordinary("a" * 3000)
    assert base64.b64encode(b"a")


@needs
def test_ids_of_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a")], "doc_id BIGINT, text STRING")
    assert sorted((r.doc_id, r.ids) for r in token_ids(df).collect()) == [(1, []), (2, []), (3, [64]), (3, [64])]
    assert token_ids(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(1, "a " * 100_000, "x", 1), (None, "a", "y", 2)], "doc_id BIGINT, text STRING, ids STRING, kind INT")
    assert sorted(len(r.ids) for r in token_ids(wide).collect()) == [1, 100_001]


def slow_best_fit(sizes, capacity):
    left, where = [], np.zeros(len(sizes), int)
    for i in np.argsort(-sizes, kind="stable"):
        fits = [x for x in left if x >= sizes[i]]
        if fits:
            b = max(k for k, x in enumerate(left) if x == min(fits)) if False else None
            b = [k for k, x in enumerate(left) if x == min(fits)][-1]
        else:
            left.append(capacity)
            b = len(left) - 1
        left[b] -= sizes[i]
        where[i] = b
    return where, len(left)


@given(st.lists(st.integers(0, 37), max_size=120))
@settings(max_examples=100, deadline=None)
def test_best_fit_equals_the_plain_search(sizes):
    sizes = np.array(sizes, np.int64)
    got = best_fit_decreasing(sizes, 37)
    _, opened = slow_best_fit(sizes, 37)
    used = np.bincount(got, sizes) if len(sizes) else np.zeros(0)
    assert len(used) == opened
    assert (used <= 37).all()


def test_cuts_keep_characters_whole():
    firsts = np.array([True, False])
    assert cuts([0, 1] * 5, 3, firsts) == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]
    assert cuts([], 3, firsts) == [(0, 0)]


@needs
def test_pack_table(spark):
    df = spark.createDataFrame([(i, "word " * (i % 40)) for i in range(300)] + [(900, None), (901, ""), (902, "word " * 200)], "doc_id BIGINT, text STRING")
    sizes = spark.createDataFrame([("a", "byte_bpe_50k", 64), ("a", "byte_bpe_50k", 64), ("b", "byte_bpe_50k", 500), ("c", None, 5)], "container_kind STRING, tokenizer STRING, capacity_tokens BIGINT")
    rows = pack(df, sizes, group_items=100).collect()
    for kind, capacity in (("a", 64), ("b", 500)):
        own = [r for r in rows if r.container_kind == kind]
        assert {r.doc_id for r in own} == {r.doc_id for r in df.collect()}
        load = {}
        for r in own:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert max(load.values()) <= capacity
        assert len(load) <= -(-sum(load.values()) // capacity) + 4
        assert len([r for r in own if r.doc_id == 902]) == (4 if kind == "a" else 1)
    assert pack(df.limit(0), sizes).count() == 0
    wide = spark.createDataFrame([(1, "a " * 1000, "x", 1, 0), (1, "a " * 1000, "x", 1, 0), (None, "b", "y", 2, 0)], "doc_id BIGINT, text STRING, container_kind STRING, kind INT, piece_no INT")
    rows = pack(wide, sizes).where("container_kind = 'b'").collect()
    assert sum(r.n_tokens for r in rows) == 2003 and len({(r.container_id, r.doc_id, r.token_start) for r in rows}) >= 4
    assert pack(wide, sizes.limit(0)).count() == 0
