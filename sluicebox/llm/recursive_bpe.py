"""Byte-pair encoding and decoding as DuckDB queries over the token positions of a partition's words."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sluicebox.llm.common import map_batches, schema_of, text_slices, whole_texts
from sluicebox.llm.tokens import IN_ONE_PIECE, vocabulary_path

#: Token rows of one query; a longer word has a query of its own.
ROWS = 400_000
CACHED_WORDS = 350_000
CACHED_CHARS = 64
#: A word with the space before it. The pattern never joins what stands before such a space with what follows.
UNITS = re.compile(r" (?=\S)")

#: Words up to so many bytes are merged by SHORT, longer ones by LONG.
SHORT_BYTES = 64

#: Words are rows of a place, which is the word and the byte offset in one number, and a token. In each round every word
#: that still has a pair in ``merges`` contracts the leftmost pair of least rank; a word without one is done. All rounds'
#: rows are kept until the end, so that this is for words of few rounds.
SHORT = """
    WITH RECURSIVE state(place, t, done) AS (
        SELECT w * 4294967296 + p, t, false FROM symbols
        UNION ALL
        (WITH pairs AS (
            SELECT place, t, lead(t) OVER (ORDER BY place) AS n, lead(place) OVER (ORDER BY place) AS next
            FROM state WHERE NOT done
        ),
        found AS (
            SELECT place >> 32 AS w, next, rank::BIGINT * 4294967296 + (place & 4294967295) AS key
            FROM pairs JOIN merges ON t = merges.l AND n = merges.r WHERE place >> 32 = next >> 32 {allowed}
        ),
        least AS (
            SELECT w, min(key) AS key, arg_min(next, key) AS gone FROM found GROUP BY w
        )
        SELECT place, CASE WHEN place & 4294967295 = key & 4294967295 THEN CAST(key >> 32 AS INT) ELSE t END, key IS NULL
        FROM pairs LEFT JOIN least ON place >> 32 = w WHERE place IS DISTINCT FROM gone)
    )
    SELECT place >> 32 AS w, t FROM state WHERE done ORDER BY place
"""

#: The same for long words. A round contracts the leftmost pair of least rank and with it the later pairs of that rank;
#: of pairs that overlap each other, as in a run of one letter, every second one. A token that its left neighbour has
#: taken in is null. Words without a pair give no row and leave the recursion. ``KEY`` keeps the last row of each place,
#: so that memory does not grow with the rounds.
LONG = """
    WITH RECURSIVE state(w, p, t) USING KEY (w, p) AS (
        SELECT w, p, t FROM symbols
        UNION ALL
        (WITH pairs AS (
            SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS n FROM state WHERE t IS NOT NULL
        ),
        ranked AS (
            SELECT w, p, t, rank FROM pairs LEFT JOIN merges ON t = merges.l AND n = merges.r
        ),
        least AS (
            SELECT *, min(rank) OVER (PARTITION BY w) AS best, row_number() OVER (PARTITION BY w ORDER BY p) AS i
            FROM ranked
        ),
        runs AS (
            SELECT *, i - coalesce(max(CASE WHEN rank IS DISTINCT FROM best THEN i END)
                OVER (PARTITION BY w ORDER BY p), 0) AS nth
            FROM least WHERE best IS NOT NULL
        ),
        hits AS (
            SELECT w, p, t, best, nth % 2 = 1 AND ({choice}) AS hit FROM runs
        ),
        taken AS (
            SELECT *, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY p) AS gone FROM hits
        )
        SELECT w, p, CASE WHEN hit THEN best WHEN NOT gone THEN t END AS t FROM taken)
    )
    SELECT w, t FROM state WHERE t IS NOT NULL ORDER BY w, p
"""
ANY_MERGE = ""
#: For words that are tokens: no merge of a higher rank than the token's own.
UP_TO_OWN_RANK = "AND rank <= (SELECT most FROM limits WHERE limits.w = place >> 32)"
ALL_OF_RANK = "true"
#: Where contracting a pair can make one of a lower rank, the leftmost pair alone is contracted.
LEFTMOST_IF_EARLY = """best NOT IN (SELECT rank FROM early)
    OR p = min(CASE WHEN rank = best THEN p END) OVER (PARTITION BY w)"""

DECODE = """
    SELECT g, string_agg(letters, '' ORDER BY p) AS letters
    FROM tokens JOIN vocabulary ON tokens.t = vocabulary.t GROUP BY g ORDER BY g
"""


def rows_of(values: np.ndarray, sizes: list[int], names: tuple[str, str, str]) -> pa.Table:
    """A row for each element of some arrays that follow each other: which array, which place, and the element."""
    length = np.array(sizes, np.int64)
    starts = np.cumsum(length) - length
    place = (np.arange(len(values)) - np.repeat(starts, length)).astype(np.int32)
    return pa.table(dict(zip(names, (np.repeat(np.arange(len(length)), length), place, values.astype(np.int32)))))


def in_portions(items: Iterable, size, most: int) -> Iterator[list]:
    """Lists of items whose sizes add up to at most ``most``, or of one larger item."""
    held, total = [], 0
    for item in items:
        if held and total + size(item) > most:
            yield held
            held, total = [], 0
        held.append(item)
        total += size(item)
    if held:
        yield held


def unpack(ids: bytes) -> list[int]:
    """Packed ids as numbers."""
    return np.frombuffer(ids, "<u4").tolist()


class MergeTables:
    """The vocabulary's merges and strings as tables of a DuckDB database in memory, one for each Python worker.

    A pair may be merged if its bytes together are a token, whose id is the pair's rank. As every pair of a token's
    parts is a row, the join finds the same pairs as a look-up of the joined bytes.

    All pairs of the least rank may be contracted in one round if no contraction makes a pair of a lower rank. Such a
    pair would be a token T whose bytes, after all merges below that rank, are not T: a token that merges up to its own
    rank do not lead to. The constructor looks for these; where they are parts of such a token, ranks go to ``early``.
    """

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pieces = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        parts = [
            (ranks[token[:i]], ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        left, right, rank = np.array(parts, np.int32).reshape(-1, 3).T
        self.connection = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self._load("merges", pa.table({"l": left, "r": right, "rank": rank}))
        strings = {"t": pa.array(ranks.values(), pa.int32()), "letters": [token.decode("latin-1") for token in ranks]}
        self._load("vocabulary", pa.table(strings))
        self.short = SHORT.format(allowed=ANY_MERGE)
        made = self._merged(SHORT.format(allowed=UP_TO_OWN_RANK), list(ranks), np.array([*ranks.values()], np.int32))
        odd = {rank for rank, ids in zip(ranks.values(), made) if unpack(ids) != [rank]}
        early = sorted({int(x) for l, r, k in parts if k in odd for x in (l, r) if x > k})
        self._load("early", pa.table({"rank": pa.array(early, pa.int32())}))
        self.long = LONG.format(choice=LEFTMOST_IF_EARLY if early else ALL_OF_RANK)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.connection.register("loaded", rows)
        self.connection.execute(f"CREATE TABLE {name} AS SELECT * FROM loaded")
        self.connection.unregister("loaded")

    def _run(self, query: str, name: str, rows: pa.Table) -> pa.Table:
        self.connection.register(name, rows)
        try:
            return self.connection.sql(query).to_arrow_table()
        finally:
            self.connection.unregister(name)

    def _merged(self, query: str, words: list[bytes], limits: np.ndarray | None = None) -> list[bytes]:
        out: list[bytes] = []
        for part in in_portions(words, len, ROWS):
            symbols = self.byte_ids[np.frombuffer(b"".join(part), np.uint8)]
            if limits is not None:
                most = pa.table({"w": np.arange(len(part)), "most": limits[len(out) : len(out) + len(part)]})
                self.connection.register("limits", most)
            found = self._run(query, "symbols", rows_of(symbols, list(map(len, part)), ("w", "p", "t")))
            ends = 4 * np.cumsum(np.bincount(found["w"].to_numpy(), minlength=len(part)))
            ids = found["t"].to_numpy().astype("<u4").tobytes()
            out += [ids[start:end] for start, end in zip([0, *ends.tolist()], ends.tolist())]
        return out

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The packed ids of words, each encoded by itself."""
        words = list(map(str.encode, pieces))
        short = [word for word in words if len(word) <= SHORT_BYTES]
        long = [word for word in words if len(word) > SHORT_BYTES]
        made = dict(zip(short + long, self._merged(self.short, short) + self._merged(self.long, long)))
        return dict(zip(pieces, map(made.__getitem__, words)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of texts.

        The different words of all texts that are new are matched by the pattern once, and those of the matches that are
        new are encoded together. ``words`` has the ids of a bounded number of words, each with the space before it, and
        ``parts`` those of a bounded number of matches.
        """
        parts, known = self.parts, self.words
        for cache in (parts, known):
            if len(cache) > CACHED_WORDS:
                cache.clear()
        split = [UNITS.split(text) if IN_ONE_PIECE.search(text) else text.split(" ") for text in texts]
        heads = [self.pieces(words.pop(0)) for words in split]
        words = list(set().union(*split).difference(known))
        # Words with one space each, before them, are matched one behind the other.
        spaced = [word for word in words if " " in word]
        joined = list(set(words).difference(spaced)) if spaced else words
        found = self.pieces("".join([" " + word for word in joined]))
        others = [self.pieces(" " + word) for word in spaced]
        fresh = list(set(found).union(*heads, *others).difference(parts))
        parts.update(self.encode_pieces(fresh))
        ids = parts.__getitem__
        known.update(zip(joined, self._by_word(joined, found)))
        known.update((word, b"".join(map(ids, pieces))) for word, pieces in zip(spaced, others))
        get = known.__getitem__
        out = [b"".join(map(ids, head)) + b"".join(map(get, words)) for head, words in zip(heads, split)]
        for cache, new in ((parts, fresh), (known, words)):
            for place, word in enumerate(new):
                if len(word) > CACHED_CHARS or place >= CACHED_WORDS:
                    del cache[word]
        return out

    def _by_word(self, words: list[str], pieces: list[str]) -> list[bytes]:
        """The ids of each word and the space before it, given the pieces of all words one behind the other."""
        made = list(map(self.parts.__getitem__, pieces))
        letters = np.cumsum([0, *map(len, pieces)])
        places = np.concatenate(([0], np.cumsum([1 + len(word) for word in words], dtype=np.int64)))
        cuts = np.cumsum([0, *map(len, made)])[np.searchsorted(letters, places)].tolist()
        ids = b"".join(made)
        return [ids[start:end] for start, end in zip(cuts, cuts[1:])]

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """The bytes of packed ids: the vocabulary's strings, aggregated in the order of the ids."""
        blocks = [
            (number, ids[start : start + ROWS])
            for number, ids in enumerate(np.frombuffer(text, "<u4") for text in texts)
            for start in range(0, len(ids), ROWS)
        ]
        out: list[list[bytes]] = [[] for _ in texts]
        for part in in_portions(blocks, lambda block: len(block[1]), ROWS):
            values = np.concatenate([ids for _, ids in part])
            found = self._run(DECODE, "tokens", rows_of(values, [len(ids) for _, ids in part], ("g", "p", "t")))
            if len(found) != len(part):
                raise ValueError("ids that the vocabulary does not have")
            for (number, _), text in zip(part, found["letters"].to_pylist()):
                out[number].append(text.encode("latin-1"))
        return [b"".join(parts) for parts in out]


@lru_cache(maxsize=2)
def merge_tables(path: str, pattern: str) -> MergeTables:
    return MergeTables(path, pattern)


def encode_by_queries(
    df: DataFrame,
    path: str | None = None,
    pattern: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    decoded: str | None = None,
) -> DataFrame:
    """The key, ``n_tokens`` and ``ids``, little-endian unsigned 32-bit numbers in one binary, of every whole text.

    ``path`` is a file of byte strings and ranks, ``pattern`` splits texts into the words that are merged by themselves.
    With ``decoded`` the ids are decoded in the same task to a binary column of that name. A null text is empty and has
    no ids. Rows are independent: repeated rows and null keys are encoded like any other, columns besides key and text
    are left out, an empty table gives no row. A task holds a slice of texts, the rows of ROWS tokens and a bounded
    number of encoded words; a longer word has a query of its own.
    """
    import public_tokenizers

    path, pattern = path or vocabulary_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    ddl = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids binary"
    ddl += f", `{decoded}` binary" if decoded else ""
    arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = merge_tables(path, pattern)
        for batch in text_slices(batches, text):
            ids = tables.encode(batch.column(text).to_pylist())
            columns = [batch.column(key), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(tables.decode(ids), pa.binary()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return map_batches(whole_texts(df, key, text), run, ddl)


def decode_by_queries(
    df: DataFrame, path: str | None = None, ids: str = "ids", name: str = "decoded"
) -> DataFrame:
    """The bytes of each row's packed ids, beside all its columns; null ids give no bytes, unknown ids are an error."""
    import public_tokenizers

    path, pattern = path or vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` binary"
    arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = merge_tables(path, pattern).decode
        for batch in text_slices(batches, ids):
            texts = pa.array(decode([i or b"" for i in batch.column(ids).to_pylist()]), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip([*batch.columns, texts], arrow)], schema=arrow
            )

    return map_batches(df, run, ddl)
