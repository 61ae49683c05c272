"""Which tokens of two vocabularies cover the same bytes, and how often each pair of ids does so in the whole corpus."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches, schema_of, share_library, text_slices, whole_texts
from sluicebox.llm.perfect_hash import PerfectHash, mixed
from sluicebox.llm.tokens import IN_ONE_PIECE, vocabulary_path
from sluicebox.session import materialise

#: A text is cut before such a space into words that both vocabularies encode by themselves: no token of either has a
#: space behind another character, and the pattern takes the space as the beginning of a token.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
WHITE = re.compile(r"\s")
#: What sentencepiece writes for a space.
SPACE = "▁"
#: White space that is neither a space nor a line end.
OTHER_WHITE = re.compile(r"[^\S\n ]")
#: So many letters of joined words are one text for the libraries.
JOINED_CHARS = 1 << 15
#: A task keeps the alignments of its words until it has so many words, or letters of words.
KNOWN_WORDS, KNOWN_CHARS = 450_000, 16 << 20
#: A task passes its counts on when it holds so many different pairs.
HELD_PAIRS = 1_000_000
#: Pairs are dealt to so many tables by a hash; vocabularies of 50,000 and 32,000 ids have 12.6 million pairs a table.
BUCKETS, BUCKET_SEED = 128, 1 << 20
#: So many vectors are added up in a task.
FAN_IN = 64
#: The tables are sent to the executors in parts of about this size, and used one after the other.
PART_BYTES = 64 << 20


class Paths(NamedTuple):
    """Files of the first vocabulary, as a library file and as ranks, its pattern, and the file of the second one."""

    library: str
    ranks: str
    pattern: str
    pieces: str


class Words(NamedTuple):
    """The alignment of some words: the number of each; how many tokens, groups and links each has, and the pairs of the
    links, word by word. A word that the second vocabulary gives back with other bytes is broken and has no link."""

    number: dict[str, int]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    broken: np.ndarray
    groups: list[str]


def in_line(line: str, count: int) -> bool:
    """Whether ``count`` words with a space between them can be encoded one behind the other: none is empty, begins with
    white space, has any within it but single line ends, or has SPACE."""
    if line.count(" ") != count - 1 or line[:1] in ("", " ", "\n") or line[-1] == " ":
        return False
    return not ("  " in line or " \n" in line or "\n\n" in line or SPACE in line or OTHER_WHITE.search(line))


class Aligner:
    """Tokens of both vocabularies and how their bytes overlap, one for each Python worker."""

    def __init__(self, paths: Paths):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(paths.library)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = True
        with open(paths.ranks, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        coding = tiktoken.Encoding("public", pat_str=paths.pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = lambda text: library.encode(text, add_special_tokens=False).ids
        self.plain = coding.encode_ordinary
        self.second = sentencepiece.SentencePieceProcessor(model_file=paths.pieces)
        self.base = self.second.vocab_size()
        self.bytes_b = [self._piece(i) for i in range(self.base)]
        #: An id with what follows it: another token of its side, the other side, or another group.
        self.spelt = [f"{i}{mark}" for i in range(max(self.base, max(ranks.values()) + 1)) for mark in ",|;"]
        self.size_a = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size_a[list(ranks.values())] = [len(token) for token in ranks]
        self.size_b = np.array([len(piece) for piece in self.bytes_b], np.int64)

    def _piece(self, number: int) -> bytes:
        piece = self.second.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(number) else piece.replace(SPACE, " ").encode()

    def words(self, text: str) -> list[str]:
        """The words of a text without the space before each; a text that begins with white space may begin with an
        empty word or one of spaces."""
        if IN_ONE_PIECE.search(text) or WHITE.match(text):
            return CUT.split(text)
        return text.split(" ")

    def align(self, words: Iterable[str], grouped: bool) -> Words:
        """The alignment of different words, each with a space before it; ``grouped`` asks for the groups as text.

        Words of letters, digits and signs are encoded one behind the other in long texts, as both vocabularies begin a
        token with each word; should one ever not, the words of that text are encoded by themselves, like all others.
        """
        words = list(words)
        alone, joined, parts = [], [], []
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // JOINED_CHARS)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)]):
            part = words[start:end]
            if not in_line(line := " ".join(part), len(part)):
                alone += [word for word in part if not in_line(word, 1)]
                part = [word for word in part if in_line(word, 1)]
                line = " ".join(part)
            if part:
                joined.append((part, line))
        for (part, line), second in zip(joined, self.second.encode([line for _, line in joined], num_threads=1)):
            made = self._aligned(line, len(part), self.plain(" " + line), second, grouped)
            if made is None:
                alone += part
            else:
                parts.append((part, made))
        for word in alone:
            made = self._aligned(word, 1, self.whole(" " + word), self.second.encode(word, num_threads=1), grouped)
            parts.append(([word], made or ([0], [0], [0], [0], [], [True], [""])))
        number = {word: i for i, word in enumerate(chain.from_iterable(part for part, _ in parts))}
        columns = list(zip(*(made for _, made in parts))) or [[]] * 7
        arrays = [np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in columns[:5]]
        broken = np.concatenate([np.zeros(0, bool), *columns[5]]).astype(bool)
        return Words(number, *arrays, broken, list(chain.from_iterable(columns[6])))

    def _aligned(self, line: str, count: int, a: list[int], b: list[int], grouped: bool) -> tuple | None:
        """The alignment of the words of a line, or of one word; None if bytes differ or a token is in two words.

        Every stretch between two ends of tokens is in one token of each side, and each overlapping pair has exactly
        one such stretch, so that the stretches are the links.
        """
        text = (" " + line).encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != text:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        if not len(a) or end_a[-1] != len(text):
            return None
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8)[1:] == 32) + 1 if count > 1 else []
        ends = np.append(spaces, len(text)).astype(np.int64)
        marks = np.zeros(len(text) + 1, np.uint8)
        marks[end_a] = 1
        marks[end_b] += 2
        if not (marks[ends] == 3).all():
            return None
        cuts, stretches = np.flatnonzero(marks == 3), np.flatnonzero(marks)
        until = [np.searchsorted(x, ends, "right") for x in (end_a, end_b, cuts, stretches)]
        counts = [np.diff(u, prepend=0) for u in until]
        pairs = a[np.searchsorted(end_a, stretches)] * self.base + b[np.searchsorted(end_b, stretches)]
        groups = [""] * count
        if grouped:
            of_a, of_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
            # Tokens in the order of the text: those of the first vocabulary before the others of their group.
            place_a = np.arange(len(a)) + np.searchsorted(of_b, of_a)
            place_b = np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")
            code = np.empty(len(a) + len(b), np.int64)
            code[place_a] = 3 * a + (marks[end_a] == 3)
            code[place_b] = 3 * b + 2 * (marks[end_b] == 3)
            spelt = list(map(self.spelt.__getitem__, code.tolist()))
            letters = np.cumsum([0, *map(len, spelt)])[np.concatenate(([0], until[0] + until[1]))].tolist()
            joined = "".join(spelt)
            groups = [joined[start : end - 1] for start, end in zip(letters, letters[1:])]
        return *counts, pairs, np.zeros(count, bool), groups


class KnownWords:
    """What a task has found out about its words, kept from one slice of its texts to the next.

    ``measure`` gives an array for each value that is kept of the words, from their alignment.
    """

    def __init__(self, both: Aligner, grouped: bool, measure: Callable[[Words], list[np.ndarray]]):
        self.both, self.grouped, self.measure = both, grouped, measure
        self.clear()

    def clear(self) -> None:
        self.number, self.values, self.groups, self.letters = {}, None, [], 0

    def full(self) -> bool:
        return len(self.number) >= KNOWN_WORDS or self.letters >= KNOWN_CHARS

    def learn(self, texts: list[list[str]]) -> None:
        """Align the words of texts, each split into words, that are not known yet."""
        new = set(chain.from_iterable(texts)).difference(self.number)
        if not new and self.values:
            return
        words = self.both.align(new, self.grouped)
        first = len(self.number)
        self.number.update((word, first + i) for word, i in words.number.items())
        self.letters += sum(map(len, new))
        self.groups += words.groups
        made = self.measure(words)
        self.values = list(map(np.concatenate, zip(self.values, made))) if self.values else made


@lru_cache(maxsize=2)
def aligner(paths: Paths) -> Aligner:
    return Aligner(paths)


def second_ids(paths: Paths) -> int:
    """How many ids the second vocabulary has."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=paths.pieces).vocab_size()


def laid_out(texts: list[list[str]], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words of texts, one text behind the other, and where each text begins, with the end."""
    starts = np.cumsum([0, *map(len, texts)])
    return np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, starts[-1]), starts


def per_text(values: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of the values of each text's words."""
    total = np.concatenate(([0], np.cumsum(values[place])))
    return total[starts[1:]] - total[starts[:-1]]


def summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, with the sum of its counts."""
    keys, place = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, counts)
    return keys, total


def bucket(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs, BUCKET_SEED) % np.uint64(BUCKETS)).astype(np.int32)


def packed(values: np.ndarray) -> bytes:
    return values.astype("<i8").tobytes()


def unpacked(value: bytes | pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py() if isinstance(value, pa.Scalar) else value, "<i8")


COUNTED = "BUCKET int, PART bigint, PAIRS binary, COUNTS binary"


def count_links(texts: DataFrame, paths: Paths, text: str) -> DataFrame:
    """For each task and bucket, the different pairs that its texts link and how many links each has."""
    arrow = schema_of(COUNTED)

    def rows(pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        of = bucket(pairs)
        order = np.argsort(of, kind="stable")
        numbers, starts = np.unique(of[order], return_index=True)
        cut = lambda values: [packed(part) for part in np.split(values[order], starts[1:])]
        # A number that only says which vectors are added up together; a repeated task gives the same one.
        part = int((mixed(pairs, 0) >> np.uint64(24)).sum() & np.uint64(0x7FFFFFFF))
        columns = [numbers, np.full(len(numbers), part), cut(pairs), cut(counts)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(paths)
        known = KnownWords(both, False, lambda words: [words.broken.astype(np.int64), words.n_links, words.pairs])
        held, times = [], np.zeros(0, np.int64)

        def settle() -> None:
            """Add the links of the words that are known, as often as texts had them, and forget the words."""
            weights = np.repeat(times, known.values[1])
            held.append(summed(known.values[2][weights > 0], weights[weights > 0]))
            known.clear()

        for batch in text_slices(batches, text):
            split = [both.words(t) for t in batch.column(text).to_pylist() if t]
            known.learn(split)
            broken = known.values[0]
            place, starts = laid_out(split, known.number)
            whole = per_text(broken, place, starts) == 0
            seen = np.bincount(place[np.repeat(whole, np.diff(starts))], minlength=len(broken))
            seen[: len(times)] += times
            times = seen
            if known.full():
                settle()
                times = np.zeros(0, np.int64)
                if sum(len(pairs) for pairs, _ in held) >= HELD_PAIRS:
                    held[:] = [summed(*map(np.concatenate, zip(*held)))]
                    if 2 * len(held[0][0]) >= HELD_PAIRS:
                        yield rows(*held.pop())
        if len(times):
            settle()
        if sum(len(pairs) for pairs, _ in held):
            yield rows(*summed(*map(np.concatenate, zip(*held))))

    return map_batches(texts, run, COUNTED)


def _fan(rows: int) -> int:
    return max(1, math.ceil(rows / FAN_IN))


def _leaf(parts: int):
    return F.pmod(F.col("PART"), F.lit(parts).cast("long")).alias("PART")


def tree(rows: DataFrame, many: int, value: str, join: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """One row a bucket: ``join`` of the arrays ``value`` of its rows, about FAN_IN of them in a task."""
    ddl = f"BUCKET int, PART bigint, `{value}` binary"
    arrow = schema_of(ddl)

    def node(key: tuple, table: pa.Table) -> pa.Table:
        made = packed(join([unpacked(v) for v in table.column(value)]))
        return pa.table([[key[0].as_py()], [key[1].as_py()], [made]], schema=arrow)

    while many > 1:
        many = _fan(many)
        rows = rows.select("BUCKET", _leaf(many), value).groupBy("BUCKET", "PART").applyInArrow(node, ddl)
    return rows.select("BUCKET", value)


HASHED = "BUCKET int, SIZES binary, BITS binary, PAIRS binary"


def hash_pairs(pairs: DataFrame) -> DataFrame:
    """A minimal perfect hash for each bucket's pairs, and the pairs in the order of their numbers."""
    arrow = schema_of(HASHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys in zip(batch.column("BUCKET").to_pylist(), batch.column("PAIRS")):
                keys = unpacked(keys)
                made = PerfectHash.of(keys)
                ordered = np.empty(len(keys), np.int64)
                ordered[made.number(keys)] = keys
                row = [[number], [packed(made.sizes)], [made.bits.astype("<u8").tobytes()], [packed(ordered)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, arrow)], schema=arrow)

    return map_batches(pairs, run, HASHED)


def perfect_hash(row: dict) -> PerfectHash:
    return PerfectHash(unpacked(row["SIZES"]), np.frombuffer(row["BITS"], "<u8"))


def verified(table: PerfectHash, keys: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of pairs, and which of the pairs the table has."""
    number = table.number(pairs)
    known = number >= 0
    known[known] = keys[number[known]] == pairs[known]
    return number, known


def dense_counts(counted: DataFrame, hashed: DataFrame, many: int) -> DataFrame:
    """The counts of each bucket as one vector in the order of the hash: vectors of tasks, added up as a tree."""
    parts = _fan(many)
    ddl = "BUCKET int, PART bigint, TOTALS binary"
    arrow = schema_of(ddl)

    def leaf(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        row = right.to_pylist()[0]
        table, keys = perfect_hash(row), unpacked(row["PAIRS"])
        total = np.zeros(len(keys), np.int64)
        for pairs, counts in zip(left.column("PAIRS"), left.column("COUNTS")):
            number, known = verified(table, keys, unpacked(pairs))
            if not known.all():
                raise RuntimeError("a counted pair is not among the hashed pairs")
            total[number] += unpacked(counts)
        return pa.table([[key[0].as_py()], [key[1].as_py()], [packed(total)]], schema=arrow)

    leaves = counted.select("BUCKET", _leaf(parts), "PAIRS", "COUNTS").groupBy("BUCKET", "PART")
    every = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    tables = hashed.select("*", F.explode(every).alias("PART"))
    vectors = leaves.cogroup(tables.groupBy("BUCKET", "PART")).applyInArrow(leaf, ddl)
    return tree(vectors, parts, "TOTALS", lambda totals: np.sum(totals, axis=0))


def highest_counts(tables: DataFrame, base: int) -> np.ndarray:
    """The highest count of a pair with each id of the second vocabulary; as many numbers as that has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, totals in zip(batch.column("PAIRS"), batch.column("TOTALS")):
                best = np.zeros(base, np.int64)
                np.maximum.at(best, unpacked(pairs) % base, unpacked(totals))
                ids = np.flatnonzero(best)
                columns = [pa.array(ids.astype(np.int32)), pa.array(best[ids])]
                yield pa.RecordBatch.from_arrays(columns, names=["ID", "BEST"])

    found = map_batches(tables.select("PAIRS", "TOTALS"), run, "ID int, BEST bigint")
    best = np.zeros(base, np.int64)
    for row in found.groupBy("ID").agg(F.max("BEST").alias("BEST")).collect():
        best[row["ID"]] = row["BEST"]
    return best


def smallest(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that has them."""
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values


def send_tables(tables: DataFrame, part_bytes: int) -> list:
    """Broadcasts of the tables in parts of about ``part_bytes``; the driver holds one part at a time.

    There are at most as many pairs as the vocabularies' ids allow, whatever the corpus; a task uses the parts one after
    the other and holds one.
    """
    context = tables.sparkSession.sparkContext
    sizes = tables.select("BUCKET", F.length("PAIRS").alias("SIZE")).orderBy("BUCKET").collect()
    parts, room = [], 0
    for row in sizes:
        if not parts or room + row["SIZE"] > part_bytes:
            parts.append([])
            room = 0
        parts[-1].append(row["BUCKET"])
        room += row["SIZE"]
    sent = []
    for numbers in parts:
        part = {}
        for row in tables.where(F.col("BUCKET").isin(numbers)).toLocalIterator():
            part[row["BUCKET"]] = (
                unpacked(row["SIZES"]),
                np.frombuffer(row["BITS"], "<u8"),
                smallest(unpacked(row["PAIRS"])),
                smallest(unpacked(row["TOTALS"])),
            )
        sent.append(context.broadcast(part))
        forget(sent[-1])
    return sent


def forget(part: Broadcast) -> None:
    """Free a broadcast's value in this process; its next use reads the local file again."""
    part.__dict__.pop("_value", None)


def look_up(sent: list, pairs: np.ndarray) -> np.ndarray:
    """The corpus count of each pair, 0 for one that the corpus does not link."""
    out = np.zeros(len(pairs), np.int64)
    of = bucket(pairs)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(BUCKETS + 1))
    for part in sent:
        for name, (sizes, bits, keys, totals) in part.value.items():
            here = order[bounds[name] : bounds[name + 1]]
            if len(here):
                number, known = verified(PerfectHash(sizes, bits), keys, pairs[here])
                out[here[known]] = totals[number[known]]
        if len(sent) > 1:
            forget(part)
    return out


def per_link(values: np.ndarray, of: np.ndarray, n_links: np.ndarray) -> np.ndarray:
    """The sum over each word's links of a value of their pairs."""
    total = np.concatenate(([0], np.cumsum(values[of], dtype=np.int64)))
    ends = np.cumsum(n_links)
    return total[ends] - total[ends - n_links]


RESULT = (
    "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, `groups` string"
)


def align_tokens(
    df: DataFrame, paths: Paths | None = None, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """The key and the alignment of the tokens of each whole text under two vocabularies.

    The texts are read twice. The first time, each task counts the links of its pairs of ids. The different pairs get
    numbers by a minimal perfect hash for each bucket, the counts are added up as vectors in the order of these numbers,
    and the vectors as a tree. The second time, words are aligned again and look their pairs up, with the pair compared.

    A null or empty text, or one that the second vocabulary gives back with other bytes, has no tokens: numbers are 0 and
    ``groups`` is empty. Repeated rows each count and each come back; null keys are kept; columns besides key and text are
    left out; an empty table gives no row.
    """
    import public_tokenizers

    spark = df.sparkSession
    paths = paths or Paths(
        vocabulary_path("byte_bpe_50k.json"),
        vocabulary_path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        vocabulary_path("piece_bpe_32k.model"),
    )
    texts = whole_texts(df, key, text)
    share_library(spark)
    counted = materialise(count_links(texts.select(text), paths, text), "links")
    many = counted.groupBy("BUCKET").count().agg(F.max("count")).first()[0] or 0
    distinct = tree(counted, max(2, many), "PAIRS", lambda lists: np.unique(np.concatenate(lists)))
    hashed = materialise(hash_pairs(distinct), "hashes")
    tables = materialise(hashed.join(dense_counts(counted, hashed, many), "BUCKET"), "tables")
    base = second_ids(paths)
    best = highest_counts(tables, base)
    sent = send_tables(tables, part_bytes)
    ddl = f"`{key}` {df.schema[key].dataType.simpleString()}, {RESULT}"
    arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(paths)

        def measure(words: Words) -> list[np.ndarray]:
            pairs, of = np.unique(words.pairs, return_inverse=True)
            counts = look_up(sent, pairs)
            # A pair without a count can only be in texts without tokens.
            uncounted = per_link(counts == 0, of, words.n_links)
            ties = per_link(counts == best[pairs % base], of, words.n_links)
            total = per_link(counts, of, words.n_links)
            broken = words.broken.astype(np.int64)
            return [words.n_a, words.n_b, words.n_groups, words.n_links, ties, total, broken, uncounted]

        known = KnownWords(both, True, measure)
        for batch in text_slices(batches, text):
            split = [both.words(t) if t else [] for t in batch.column(text).to_pylist()]
            known.learn(split)
            place, starts = laid_out(split, known.number)
            *sums, broken, uncounted = (per_text(n, place, starts) for n in known.values)
            none = (broken > 0) | (np.diff(starts) == 0)
            if uncounted[~none].any():
                raise RuntimeError("the texts hold a pair of tokens that they did not hold when pairs were counted")
            ids = place.tolist()
            groups = [
                "" if empty else ";".join(map(known.groups.__getitem__, ids[start:end]))
                for empty, start, end in zip(none.tolist(), starts.tolist(), starts[1:].tolist())
            ]
            columns = [batch.column(key), *map(pa.array, np.where(none, 0, sums)), pa.array(groups, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
            if known.full():
                known.clear()

    return map_batches(texts, run, ddl)
