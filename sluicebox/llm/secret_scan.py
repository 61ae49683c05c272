"""Secrets in whole texts: fixed patterns, and strings that a public vocabulary needs unusually many tokens for."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import map_texts, measures
from sluicebox.llm.tokens import WordCache, kept_by_task, vocabulary_path

#: The base patterns. A match below the least length is dropped.
ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "random")

#: What the token test looks at: runs of the letters that keys are written in.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Ordinary words take 2.2 characters a token or more, also in invented prose; random keys about 1.5.
CHARS_PER_TOKEN = 1.8
#: Digests by their length in hexadecimal digits: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST = re.compile(r"(?ai:(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}))")
#: Identifiers: UUIDs, plain numbers with separators, rulers, and words joined by separators.
IDENTIFIER = re.compile(
    r"(?ai:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9/_=+-]+|[/_=+-]*[a-z]+(?:[/_=+-]+[a-z]+)+[/_=+-]*)"
)
LEAST_RANDOM = 20
#: Parts of a run, and those that are words, also several joined by capitals, or numbers. Shorter ones may be of a key.
UUID = r"(?ai:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"
PART = re.compile(rf"(?<![A-Za-z0-9+]){UUID}(?![A-Za-z0-9+])|[A-Za-z0-9+]+")
ORDINARY = re.compile(UUID + r"|[A-Z]?[a-z]{3,19}|[A-Z]{4,19}|[a-z]+(?:[A-Z][a-z]+)+|[0-9]{4,19}|[a-z]{4,19}[0-9]{1,4}")
#: So many texts are redacted before they go on.
REDACTED_ROWS = 200

Span = tuple[str, int, int]


@kept_by_task
def token_counts(path: str) -> WordCache:
    """The number of tokens of a string under a tiktoken vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    coding = tiktoken.Encoding(
        "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return WordCache(lambda text: len(coding.encode_ordinary(text)), 50_000)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, leftmost and not overlapping within a kind, in code points."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def is_random(run: str, counts: WordCache, least: float) -> bool:
    """Below ``least`` characters a token, long enough, and no digest or identifier."""
    if len(run) < LEAST_RANDOM or DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return False
    return len(run) < least * counts[run]


def random_parts(text: str, start: int, end: int, counts: WordCache, least: float) -> list[Span]:
    """The whole run, or else the parts of it between separators that are random.

    A key may hold separators itself, so neighbouring parts that are no words, numbers, digests or UUIDs are one part.
    """
    if is_random(text[start:end], counts, least):
        return [("random", start, end)]
    found, groups = [], []
    for match in PART.finditer(text, start, end):
        if ORDINARY.fullmatch(match[0]) or DIGEST.fullmatch(match[0]):
            groups.append([])
        elif groups:
            groups[-1].append(match.span())
        else:
            groups.append([match.span()])
    for group in filter(None, groups):
        whole = ("random", group[0][0], group[-1][1])
        # A padded key ends with its padding.
        while whole[2] < end and text[whole[2]] == "=":
            whole = ("random", whole[1], whole[2] + 1)
        if is_random(text[whole[1] : whole[2]], counts, least):
            found.append(whole)
        elif len(group) > 1:
            found += [("random", s, e) for s, e in group if is_random(text[s:e], counts, least)]
    return found


def random_spans(text: str, counts: WordCache, known: list[Span], least: float = CHARS_PER_TOKEN) -> list[Span]:
    """Runs and parts of runs below ``least`` characters a token that are no digest or identifier.

    Known spans are cut out of a run, and what is left on either side is looked at like a run.
    """
    found = []
    for match in CANDIDATE.finditer(text):
        start, end = match.span()
        for _, s, e in known:  # by start; spans of different kinds may overlap
            if s < end and start < e:
                if s > start:
                    found += random_parts(text, start, s, counts, least)
                start = max(start, e)
        if start < end:
            found += random_parts(text, start, end, counts, least)
    return found


def find_secrets(text: str, counts: WordCache) -> list[Span]:
    """All spans of a text, by start and then kind."""
    base = base_spans(text)
    return in_order(base + random_spans(text, counts, base))


def redact_text(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, done = [], 0
    for _, start, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out) + text[done:]


def scan_secrets(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``spans``, an array of kind, start and end in code points, for every whole text.

    A null or empty text has no spans. Rows are independent, so repeated rows and null keys need no care, and a very
    long text is scanned whole. Nothing is shuffled.
    """
    path = path or vocabulary_path("byte_bpe_50k.tiktoken")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def work(texts: list[str | None]) -> dict[str, object]:
        counts = token_counts(path)
        spans = [find_secrets(t or "", counts) for t in texts]
        return {"spans": [[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in spans]}

    ddl = f"{kept}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return map_texts(df, work, ddl, keep, text)


def redact_secrets(df: DataFrame, row: str, text: str = "text", path: str | None = None) -> DataFrame:
    """The struct column ``row`` and ``redacted``, the text with its secrets replaced; a null text stays null.

    Only the text goes to Python and back, as the row may hold it once more.
    """
    path = path or vocabulary_path("byte_bpe_50k.tiktoken")

    def work(texts: pa.Array) -> dict[str, object]:
        counts = token_counts(path)
        clean = [None if t is None else redact_text(t, find_secrets(t, counts)) for t in texts.to_pylist()]
        return {"redacted": pa.array(clean, pa.string())}

    redacted = measures(df, F.col(text), work, "redacted string", REDACTED_ROWS).getField("redacted")
    return df.select(row, redacted.alias("redacted"))
