"""Best-fit decreasing packing of documents into sequences of bounded length."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches, materialise_texts, numbered, schema_of, text_slices, whole_texts
from sluicebox.llm.tokens import rank_encoder, vocabulary_path

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = f"{PIECES}, sequence_id long, offset long"


class Run(NamedTuple):
    """``items`` pieces of one length, from rank ``rank`` on, ``each`` to a bin, in bins from ``bin`` on at ``offset``."""

    length: int
    rank: int
    items: int
    each: int
    bin: int
    offset: int


class OpenBins:
    """A segment tree over remaining capacities: each leaf counts the open bins with just that much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += bins
            node //= 2

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that an open bin has."""
        node = length + self.leaves
        while not self.count[node]:
            while node & 1:
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over ``lengths``, which counts the items of each length from 1 to ``capacity``.

    Items of one length are alike, so the bins that take them are handled as intervals of bin numbers: a bin that was
    the tightest stays so until it has no room for another such item, and then the next one with as much room follows.
    The result is that of placing the items one by one, while work and memory depend on the capacity, not on the number
    of items.
    """
    tree, rooms = OpenBins(capacity), defaultdict(deque)
    runs: list[Run] = []
    bins = 0
    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, fresh = capacity, -(-left // (capacity // length))
                first, count = bins, fresh
                bins += fresh
            else:
                first, count = rooms[room].popleft()
                tree.add(room, -count)
            each = room // length
            full = min(count, left // each)
            parts = [(first, full, each), (first + full, 1, left - full * each)] if full < count else [(first, full, each)]
            for at, used, items in parts:
                if not used or not items:
                    continue
                runs.append(Run(length, rank, used * items, items, at, capacity - room))
                rank, left = rank + used * items, left - used * items
                if rest := room - items * length:
                    rooms[rest].append((at, used))
                    tree.add(rest, used)
            used = sum(u for _, u, items in parts if u and items)
            if used < count:
                rooms[room].appendleft((first + used, count - used))
                tree.add(room, count - used)
    return runs


def cut_lengths(tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, the first may be shorter."""
    head = tokens % capacity
    return ([head] if head else []) + [capacity] * (tokens // capacity)


def token_pieces(
    docs: DataFrame, path: str, rank_path: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """A row for each piece of each document: the document's ids and ``end_id``, cut only where longer than ``capacity``."""
    arrow = schema_of(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = rank_encoder(path, rank_path), struct.pack("<I", end_id)
        for batch in text_slices(batches):
            rows: list[tuple] = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview(encoder.ids(text) + end)
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((key, piece, start, length, crc))
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*rows), arrow)], schema=arrow
            )

    return map_batches(whole_texts(docs).select(F.col("doc_id").cast("long"), "text"), run, PIECES)


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    rank_path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Where each piece of each document goes: ``sequence_id`` and ``offset`` there.

    The count of each length, at most ``capacity`` rows however many documents there are, goes to the driver. It packs
    these counts by best-fit decreasing over all documents at once; pieces of one length are numbered over all tasks, and
    each finds its bin from its length and number. A null text is an empty document, of the end id alone; repeated rows
    are documents of their own, and ties in length go by document, piece and checksum. An empty table gives no row.
    """
    path, rank_path = path or vocabulary_path("byte_bpe_50k.json"), rank_path or vocabulary_path("byte_bpe_50k.tiktoken")
    pieces = materialise_texts(token_pieces(docs, path, rank_path, capacity, end_id), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = best_fit_decreasing(lengths, capacity)
    runs.sort()
    shift = 1 << 44
    begin = np.array([r.length * shift + r.rank for r in runs], np.int64)
    rank, each, first, offset = (
        np.array([getattr(r, name) for r in runs], np.int64) for name in ("rank", "each", "bin", "offset")
    )

    arrow = schema_of(PLACES)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, length = (batch.column(name).to_numpy() for name in ("number", "length"))
            at = np.searchsorted(begin, length * shift + number, side="right") - 1
            within = number - rank[at]
            made = first[at] + within // each[at], offset[at] + within % each[at] * length
            columns = [batch.column(name) for name in arrow.names[:-2]] + [pa.array(x) for x in made]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return map_batches(numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "number"), place, PLACES)
