"""Byte-pair encoding by a queue of merge ranks over a linked list of symbols, and decoding by the vocabulary's strings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sluicebox.llm.common import list_array, map_batches, schema_of, text_slices, whole_texts
from sluicebox.llm.tokens import SPECIAL, ByteLevel, WordCache, vocabulary_path


#: Ids are below PAIR - 1; NONE is no id.
PAIR = 1 << 20
NONE = PAIR - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def merge_symbols(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge neighbours in the order of their ranks, the leftmost first among equals.

    ``ranks`` has the rank of a pair under left * PAIR + right, ``merged`` the id that a rank gives. The symbols are a
    doubly linked list. A queue entry is a rank and a place; it is stale if the pair that begins there now has another
    rank, or none, or if the symbol there has been taken in by its left neighbour: ``begins`` has that rank.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    rank_of, shift = ranks.get, n.bit_length()
    mask = (1 << shift) - 1
    ids, before, after = symbols + [NONE], list(range(-1, n - 1)), list(range(1, n + 1))
    begins = [rank_of(left * PAIR + right, -1) for left, right in zip(symbols, symbols[1:])]
    queue = [rank << shift | i for i, rank in enumerate(begins) if rank >= 0]
    begins += [-1, -1]
    heapify(queue)
    while queue:
        entry = heappop(queue)
        rank, left = entry >> shift, entry & mask
        if begins[left] != rank:
            continue
        right = after[left]
        ids[left] = new = merged[rank]
        ids[right], begins[right] = NONE, -1
        after[left] = then = after[right]
        begins[left] = found = rank_of(new * PAIR + ids[then], -1)
        if found >= 0:
            heappush(queue, found << shift | left)
        if then < n:
            before[then] = left
        earlier = before[left]
        if earlier >= 0:
            begins[earlier] = found = rank_of(ids[earlier] * PAIR + new, -1)
            if found >= 0:
                heappush(queue, found << shift | earlier)
    return [i for i in ids if i != NONE]


class Vocabulary:
    """Encoding and decoding by one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        ids: dict[str, int] = read["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        merges = read["model"]["merges"]
        self.ranks = {ids[a] * PAIR + ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]
        letters = byte_letters()
        byte = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = [ids[letter] for letter in letters]
        self.strings = {i: bytes(byte[c] for c in token) for token, i in ids.items()}
        self.strings |= {i: token.encode() for token, i in self.special.items()}
        self.pieces = regex.compile(pattern).findall
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.piece = WordCache(self.encode_piece)
        self.level = ByteLevel(self.encode)

    def encode_piece(self, piece: str) -> list[int]:
        return merge_symbols([self.byte_ids[b] for b in piece.encode()], self.ranks, self.merged)

    def encode(self, text: str) -> list[int]:
        """The ids of a text; special tokens in it stand for themselves."""
        parts = self.splits.split(text) if self.splits and SPECIAL in text else [text]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            else:
                for piece in self.pieces(part):
                    out += self.piece[piece]
        return out

    def decode(self, ids: list[int]) -> str:
        """The strings of the ids one after the other; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_texts(
    df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", decoded: str | None = None
) -> DataFrame:
    """The key and ``ids``, an array of token ids, of every whole text; a null text is empty and has no ids.

    With ``decoded`` the ids are decoded at once, in the same task, to a column of that name. Rows are independent:
    repeated rows and null keys are encoded like any other, an empty table gives no row.
    """
    path, pattern = path or vocabulary_path("byte_bpe_50k.json"), _pattern()
    ddl = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>"
    ddl += f", `{decoded}` string" if decoded else ""
    arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in text_slices(batches, text):
            ids = [np.frombuffer(words.level.ids(t), "<u4") for t in batch.column(text).to_pylist()]
            columns = [batch.column(key), list_array(ids, pa.int32())]
            if decoded:
                columns.append(pa.array([words.decode(i.tolist()) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return map_batches(whole_texts(df, key, text), run, ddl)


def decode_ids(df: DataFrame, path: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The text of each row's ids, beside all its columns; null or empty ids give an empty text."""
    path, pattern = path or vocabulary_path("byte_bpe_50k.json"), _pattern()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` string"
    arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(path, pattern).decode
        for batch in batches:
            column = batch.column(ids)
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip([*batch.columns, pa.array(texts, pa.string())], arrow)], schema=arrow
            )

    return map_batches(df, run, ddl)
