"""Alignment of two vocabularies against marking every byte with its tokens, and the perfect hash against its promise."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import sluicebox.llm.token_alignment as token_alignment
from sluicebox.llm.bpe import byte_letters
from sluicebox.llm.perfect_hash import PerfectHash
from sluicebox.llm.token_alignment import align_tokens
from sluicebox.llm.tokens import vocabulary_path

FIRST = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
LETTER = {letter: b for b, letter in enumerate(byte_letters())}
ODD = ["", " ", "   ", " lead", "trail ", "a  b   c", "a\n b", "\n x", "▁x y", "one ▁ two", "<|endoftext|> <s> <0x41>"]
ODD += ["unheard-of zyzzyva ▁ words", "日本 語", "🙂  🙂🙂", "a\x00b \x1c c", "naïve é ﬁ", "x y", "tab\t tab", "it's 12345 9"]


def piece_bytes(i):
    piece = SECOND.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if SECOND.is_byte(i) else piece.replace("▁", " ").encode()


def by_definition(texts):
    """What each text has, by the tokens of each byte of the whole text."""
    found = []
    for text in texts:
        a = FIRST.encode(" " + text, add_special_tokens=False).ids if text else []
        b = SECOND.encode(text) if text else []
        parts_a = [bytes(LETTER[c] for c in FIRST.id_to_token(i)) for i in a]
        parts_b = [piece_bytes(i) for i in b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            found.append(None)
            continue
        of_a, of_b = ([k for k, part in enumerate(parts) for _ in part] for parts in (parts_a, parts_b))
        ends = [set(np.cumsum([len(part) for part in parts]).tolist()) for parts in (parts_a, parts_b)]
        groups, start = [], 0
        for end in sorted(ends[0] & ends[1]):
            ids = [[str(x[k]) for k in sorted(set(of[start:end]))] for x, of in ((a, of_a), (b, of_b))]
            groups.append("|".join(map(",".join, ids)))
            start = end
        links = [(a[i], b[j]) for i, j in set(zip(of_a, of_b))]
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(link for text in found if text for link in text[3])
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for text in found:
        if text is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            ties = sum(counts[link] == best[link[1]] for link in text[3])
            out.append((*text[:3], len(text[3]), ties, sum(counts[link] for link in text[3]), text[4]))
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(" \n\t\x1c ▁abé1'.<日🙂"), max_size=30) | st.text(max_size=30))
def test_words_join_to_the_whole_text(text):
    both = token_alignment.aligner(default_paths())
    split = both.words(text) if text else []
    words = both.align(set(split), True)
    numbers = [words.number[word] for word in split]
    expected = by_definition([text])[0]
    if not split or words.broken[numbers].any():
        assert expected == (0, 0, 0, 0, 0, 0, "")
    else:
        assert ";".join(words.groups[i] for i in numbers) == expected[6]
        found = (words.n_a, words.n_b, words.n_groups, words.n_links)
        assert tuple(int(n[numbers].sum()) for n in found) == expected[:4]
        assert len(words.pairs) == words.n_links.sum()


def default_paths():
    import public_tokenizers

    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return token_alignment.Paths(
        *map(vocabulary_path, names), public_tokenizers.PATTERN, vocabulary_path("piece_bpe_32k.model")
    )


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    """Also with tasks that pass counts on early, trees of three vectors, small caches, and tables in many parts."""
    if small:
        monkeypatch.setattr(token_alignment, "HELD_PAIRS", 40)
        monkeypatch.setattr(token_alignment, "FAN_IN", 3)
        monkeypatch.setattr(token_alignment, "JOINED_CHARS", 10)
    rows = [(i, t, 1) for i, t in enumerate(ODD)]
    rows += [(100 + i, f"the number {i} of {'many ' * (i % 5)}documents, naïveté {i * 7919}", 2) for i in range(60)]
    rows += [(500, "copies of one text", 3)] * 30 + [(None, None, 4), (None, "no key", 4), (7, "used twice", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int")
    found = align_tokens(df.repartition(6), part_bytes=200 if small else 1 << 20)
    assert found.columns[0] == "doc_id" and found.columns[1:] == [c.split()[0].strip("`") for c in token_alignment.RESULT.split(", ")]
    got = sorted(str(tuple(r)) for r in found.collect())
    assert got == sorted(str((k, *e)) for (k, _, _), e in zip(rows, by_definition([t or "" for _, t, _ in rows])))


def test_no_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert sorted(tuple(r) for r in align_tokens(df).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
    assert align_tokens(df.limit(0)).count() == 0


def test_query_over_the_table(spark):
    from sluicebox.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, QUERIES["op12_hashed_alignment"](spark, folder).collect()))
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    digest = lambda groups: hashlib.sha256(groups.encode()).hexdigest() if groups else ""
    expected = by_definition([r.text or "" for r in rows])
    assert got == sorted((r.doc_id, *e[:6], digest(e[6])) for r, e in zip(rows, expected))


@pytest.mark.parametrize("size", [0, 1, 2, 63, 64, 65, 5000])
def test_hash_is_minimal_and_perfect(size):
    keys = np.unique(np.random.default_rng(size).integers(0, 1 << 62, size))
    table = PerfectHash.of(keys)
    assert sorted(table.number(keys).tolist()) == list(range(len(keys)))
    again = PerfectHash(table.sizes, table.bits)
    assert (again.number(keys[::-1]) == table.number(keys)[::-1]).all()


def test_other_pairs_are_told_apart():
    keys = np.arange(0, 3000, 3)
    table = PerfectHash.of(keys)
    ordered = np.empty_like(keys)
    ordered[table.number(keys)] = keys
    number, known = token_alignment.verified(table, ordered, np.arange(3000))
    assert known.tolist() == [i % 3 == 0 for i in range(3000)] and (ordered[number[known]] == keys).all()


def test_words_are_aligned_once_and_forgotten_when_many(monkeypatch):
    both = token_alignment.aligner(default_paths())
    real, asked = both.align, []
    monkeypatch.setattr(both, "align", lambda words, grouped: asked.extend(words) or real(words, grouped))
    known = token_alignment.KnownWords(both, True, lambda words: [words.n_a, words.n_links])
    slices = [[["one", "two"], [], ["two"]], [[]], [["two", "three", "a  b"], ["one"]], [["▁", "three"]]]
    for texts in slices:
        known.learn(texts)
    assert sorted(asked) == sorted({word for texts in slices for text in texts for word in text})
    whole = real(set(asked), True)
    for word, i in known.number.items():
        j = whole.number[word]
        assert known.groups[i] == whole.groups[j]
        assert [v[i] for v in known.values] == [whole.n_a[j], whole.n_links[j]]
    assert not known.full()
    monkeypatch.setattr(token_alignment, "KNOWN_CHARS", 15)
    assert known.full()
    known.clear()
    assert not known.full() and not known.number and not known.groups
    monkeypatch.setattr(token_alignment, "KNOWN_WORDS", 0)
    assert known.full()


@pytest.mark.parametrize(("words", "pairs"), [(1 << 20, 1 << 20), (5, 1 << 20), (5, 40)])
def test_slices_share_words(spark, monkeypatch, words, pairs):
    """Over many slices a task, with words kept, forgotten in between, and counts passed on early."""
    import sluicebox.llm.common as common

    monkeypatch.setattr(token_alignment, "KNOWN_WORDS", words)
    monkeypatch.setattr(token_alignment, "HELD_PAIRS", pairs)
    monkeypatch.setattr(common, "TEXT_BATCH_BYTES", 60)
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, f"the number {i % 9} of {'many ' * (i % 5)}documents, naïveté {i * 7919}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(str(tuple(r)) for r in align_tokens(df).collect())
    assert got == sorted(str((k, *e)) for (k, _), e in zip(rows, by_definition([t for _, t in rows])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\x1c ▁aé1"), max_size=4), min_size=1, max_size=4))
def test_lines_hold_what_can_stand_in_a_line(words):
    fits = [bool(re.fullmatch(r"\S+(?:\n\S+)*\n?", word)) and "▁" not in word for word in words]
    assert [token_alignment.in_line(word, 1) for word in words] == fits
    assert token_alignment.in_line(" ".join(words), len(words)) == all(fits)
