"""Ids of whole texts by a public byte-level vocabulary, word by word with a bounded cache."""

from __future__ import annotations

import array
import base64
import os
import re
import sys
import weakref
from collections.abc import Callable
from functools import lru_cache

CACHED_WORDS = 450_000
CACHED_CHARS = 64
#: Of all caches of a Python worker.
WORDS_IN_ALL = 950_000
#: Fixed value: the one special token of the vocabulary.
SPECIAL = "<|endoftext|>"
#: A space before white space or at the end, or a special token: such texts are encoded in one piece.
IN_ONE_PIECE = re.compile(r" (?:\s|\Z)|" + re.escape(SPECIAL))


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabulary of this name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    made = array.array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


#: What :func:`kept_by_task` keeps in this Python worker.
_kept: list = []


def kept_by_task(load: Callable) -> Callable:
    """Keep what ``load`` returns until a task of another function begins in this Python worker."""
    kept = lru_cache(maxsize=2)(load)
    _kept.append(kept)
    return kept


class WordCache(dict):
    """What ``make`` gives for a word. It is cleared when full, so that its memory is bounded whatever the texts hold.

    A Python worker runs many stages. When all its caches together are too large, those not in use just now are cleared.
    """

    known: list[weakref.ref] = []
    owner: str | None = None

    def __init__(self, make: Callable[[str], object], words: int = CACHED_WORDS):
        super().__init__()
        self.make, self.words = make, words
        WordCache.known = [ref for ref in WordCache.known if ref() is not None] + [weakref.ref(self)]

    @classmethod
    def begin(cls, owner: str) -> None:
        """Clear all caches and vocabularies of this worker if its last task was another's: later stages get the memory back."""
        if cls.owner != owner:
            cls.owner = owner
            for kept in _kept:
                kept.cache_clear()
            for ref in cls.known:
                if (cache := ref()) is not None:
                    cache.clear()

    def make_room(self) -> None:
        others = [cache for ref in WordCache.known if (cache := ref()) is not None and cache is not self]
        if len(self) + sum(map(len, others)) > WORDS_IN_ALL:
            for cache in others:
                cache.clear()

    def __missing__(self, word: str) -> object:
        value = self.make(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= self.words:
                self.clear()
            if not len(self) % 4096:
                self.make_room()
            self[word] = value
        return value


class ByteLevel:
    """Little-endian unsigned 32-bit ids of texts.

    The vocabulary's pattern never joins what stands before a single space with what follows it, so each word is encoded
    with the space before it. ``encode`` gives the ids of a text; it sees words, and whole texts where that rule fails.
    """

    def __init__(self, encode: Callable[[str], list[int]]):
        pack = lambda text: packed(encode(text))
        self.whole = pack
        self.word = WordCache(lambda word: pack(" " + word))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if IN_ONE_PIECE.search(text):
            return self.whole(text)
        first, *words = text.split(" ")
        return self.whole(first) + b"".join(map(self.word.__getitem__, words)) if first else b"".join(
            map(self.word.__getitem__, words)
        )


@kept_by_task
def library_encoder(path: str) -> ByteLevel:
    """The tokenizers library's ids, one encoder for each Python worker; its own threads are off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return ByteLevel(lambda text: tokenizer.encode(text, add_special_tokens=False).ids)


@kept_by_task
def rank_encoder(path: str, rank_path: str) -> ByteLevel:
    """The same ids with words from the same vocabulary's rank file, by a library that is faster on single words.

    Texts in which a special token or an odd run of white space could tell the two apart go to the tokenizers library.
    """
    import public_tokenizers
    import tiktoken

    with open(rank_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    coding = tiktoken.Encoding(
        "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    whole = library_encoder(path).whole
    level = ByteLevel(coding.encode_ordinary)
    first = level.whole
    level.whole = lambda text: whole(text) if IN_ONE_PIECE.search(text) else first(text)
    return level
