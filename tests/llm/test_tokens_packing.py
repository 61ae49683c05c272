"""Tokens, byte-pair coding and packing against the tokenizers library and against packing item by item."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluicebox.llm.bpe import _pattern, decode_ids, encode_texts, merge_symbols, vocabulary
from sluicebox.llm.packing import best_fit_decreasing, cut_lengths, pack_documents
from sluicebox.llm.tokens import WordCache, rank_encoder, vocabulary_path

PATH, RANKS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "  ", "a\n \nb", "a\n ", "x <|endoftext|> y", "a\n <|endoftext|>", "<|endoftext|", " a   b", "naïve café 日本語 🙂🙂"]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def ids(encoder, text):
    return np.frombuffer(encoder.ids(text), "<u4").tolist()


pieces = st.lists(
    st.one_of(
        st.text(max_size=12),
        st.sampled_from([" ", "  ", "\n", "\t", "the", "it's", "<|endoftext|>", "1234", "　", "\x1c", "é", "ﬁ", "\r\n "]),
    ),
    max_size=12,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_ids_and_round_trip(text):
    want = library(text)
    own = vocabulary(PATH, _pattern())
    assert ids(own.level, text) == want
    assert ids(rank_encoder(PATH, RANKS), text) == want
    assert own.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD + ["a" * 5000, "ab" * 3000 + " " + "é" * 500])
def test_odd_and_long_texts(text):
    assert ids(vocabulary(PATH, _pattern()).level, text) == library(text)
    assert ids(rank_encoder(PATH, RANKS), text) == library(text)


def test_broken_bytes_decode_as_the_library_does():
    own = vocabulary(PATH, _pattern())
    for broken in ([own.byte_ids[0xE2], own.byte_ids[0x82]], [own.byte_ids[0xFF], own.byte_ids[65]], [own.byte_ids[0xF0]]):
        assert own.decode(broken) == LIBRARY.decode(broken, skip_special_tokens=False)


def test_merges_by_rank_and_then_from_the_left():
    pair = lambda a, b: a * (1 << 20) + b
    ranks, merged = {pair(1, 1): 0, pair(2, 1): 1, pair(2, 2): 2}, [2, 3, 4]
    assert merge_symbols([1, 1, 1, 1, 1], ranks, merged) == [2, 3]
    assert merge_symbols([1], ranks, merged) == [1] and merge_symbols([], ranks, merged) == []


def test_cache_is_bounded():
    cache = WordCache(len, 3)
    assert [cache[w] for w in ("a", "bb", "ccc", "dddd", "a", "x" * 100)] == [1, 2, 3, 4, 1, 100]
    assert len(cache) <= 3 and "x" * 100 not in cache


def test_operator_columns(spark):
    rows = [(1, None, "ids"), (1, "", "x"), (None, "hello world", "y"), (2, "hello world", "z"), (2, "hello world", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = encode_texts(df, decoded="decoded").collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in found] == [(k, library(t or ""), t or "") for k, t, _ in rows]
    again = decode_ids(encode_texts(df)).collect()
    assert [r.decoded for r in again] == [r.decoded for r in found]
    assert encode_texts(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in decode_ids(nulls).collect()] == ["", ""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 64))
def test_packing_is_best_fit_decreasing_item_by_item(lengths, capacity):
    lengths = [min(n, capacity) for n in lengths]
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bins += room == capacity and at >= len(rooms)
        bisect.insort(rooms, room - n)
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = best_fit_decreasing(counts, capacity)
    filled = {}
    for run in runs:
        for i in range(run.items):
            at = run.bin + i // run.each
            assert run.offset + i % run.each * run.length == filled.get(at, 0)
            filled[at] = filled.get(at, 0) + run.length
    assert sorted(capacity - f for f in filled.values()) == rooms
    assert all(sum(r.items for r in runs if r.length == n) == c for n, c in counts.items())


def test_cuts():
    assert [cut_lengths(n, 10) for n in (1, 10, 11, 25, 30)] == [[1], [10], [1, 10], [5, 10, 10], [10, 10, 10]]


@pytest.mark.parametrize("hot", [False, True])
def test_packed_documents(spark, hot):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "unbelievable"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += [None, "", "long " * 3000] + ["same text"] * (90 if hot else 3)
    rows = [(i if i % 7 else 7, t, "x") for i, t in enumerate(texts)] + [(None, "null key", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(7)
    found = pack_documents(df, capacity=128).toPandas()
    assert list(found.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for _, group in found.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group.offset.tolist() == [0, *group.length.cumsum()[:-1]] and group.length.sum() <= 128
    want = []
    for key, text, _ in rows:
        tokens, start = library(text or "") + [2], 0
        for piece, n in enumerate(cut_lengths(len(tokens), 128)):
            want.append((key, piece, start, n, zlib.crc32(np.array(tokens[start : start + n], "<u4").tobytes())))
            start += n
    got = [(None if k != k else int(k), *r) for k, *r in found[list(found.columns)[:5]].itertuples(index=False)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert pack_documents(df.limit(0)).count() == 0
