"""Quality rules: counts of words, lines and symbols, and how well public vocabularies fit a text."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import materialise_texts, measures
from sluicebox.llm.tokens import WordCache, kept_by_task, vocabulary_path
from sluicebox.session import materialise

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Entropy is compared with that of as many different tokens, up to this number.
ENTROPY_TOKENS = 256
#: Texts of fewer tokens vary more; the deviation counts by the root of the share.
STEADY_TOKENS = 512
#: A band reaches so many robust standard deviations from the language's median.
BANDS = {"chars_per_token": (-4.5, None), "byte_share": (None, 10.0), "token_entropy": (-3.0, None)}
#: The least standard deviation of each measure, so that a uniform language has no empty band.
LEAST_SPREAD = {"chars_per_token": 0.02, "byte_share": 0.004, "token_entropy": 0.02}
#: The spread is at most so many times that of the half of the texts that lies away from the band's limit. Garbage lies
#: on the side of the limit, so that it cannot widen its own band unless it is half of the language.
MOST_SPREAD = 1.5
#: Limits that hold whatever the rest of a language is. Characters a token by language, as text of these languages has
#: at least, also invented words; random letters a-z have 1.53, letters and digits 1.26, symbols 1.09.
LANGUAGE_LIMITS = {"en": 1.7, "de": 1.7, "fr": 1.6, "es": 1.57}
#: For other languages by script, told by bytes a character: Latin letters mostly (below the first number), or others,
#: whose letters may take several tokens each.
LATIN_BYTES, LATIN_LIMIT, OTHER_LIMIT = 1.2, 1.3, 0.2
#: Byte fallbacks are rare in a script that the piece vocabulary knows: up to 0.1 in the samples seen, emojis have 0.8.
BYTE_LIMIT, ENTROPY_LIMIT = 0.5, 0.3

#: So many texts are measured before their measures go on.
MEASURED_ROWS = 200

MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_tokens bigint, chars_per_token double, byte_share double, token_entropy double"
)
#: What the limits need besides.
INTERNAL = "WORD_BYTES bigint"


@kept_by_task
def token_caches(byte_level: str, pieces: str) -> tuple[WordCache, WordCache, np.ndarray]:
    """Ids of a word under the byte-level and the piece vocabulary, and which piece ids stand for a byte."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(byte_level, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    coding = tiktoken.Encoding(
        "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    fallback = np.array([model.is_byte(i) for i in range(model.vocab_size())])
    pack = lambda ids: np.asarray(ids, "<u2").tobytes()
    return (
        WordCache(lambda word: pack(coding.encode_ordinary(" " + word.decode())), 300_000),
        WordCache(lambda word: pack(model.encode(word.decode(), num_threads=1)), 300_000),
        fallback,
    )


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in windows of three words that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    number: dict[tuple, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in windows])
    twice = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Bits a token, as a share of what ENTROPY_TOKENS tokens, or as many as there are, could have at most."""
    if len(ids) < 2:
        return 1.0
    counts = np.unique(ids, return_counts=True)[1]
    share = counts / len(ids)
    return float(-(share * np.log2(share)).sum() / np.log2(min(len(ids), ENTROPY_TOKENS)))


def measure_text(text: str, byte_level: WordCache, pieces: WordCache, fallback: np.ndarray) -> tuple:
    encoded = text.encode()
    words = encoded.split()
    chars = len(text) - sum(map(text.count, SPACES))
    ids = np.frombuffer(b"".join(map(byte_level.__getitem__, words)), "<u2")
    parts = np.frombuffer(b"".join(map(pieces.__getitem__, words)), "<u2")
    return (
        len(words),
        chars,
        sum(map(text.count, SYMBOLS)),
        repeated_lines(text),
        repeated_words(words),
        len(ids),
        chars / len(ids) if len(ids) else 0.0,
        float(fallback[parts].mean()) if len(parts) else 0.0,
        entropy(ids),
        len(encoded) - len(text) + chars,
    )


def measure_texts(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and, in ``MEASURED``, the measures of every whole text; a null text has no words."""
    paths = vocabulary_path("byte_bpe_50k.tiktoken"), vocabulary_path("piece_bpe_32k.model")
    made = f"{MEASURES}, {INTERNAL}"
    names = [part.split()[0] for part in made.split(", ")]

    def work(texts: pa.Array) -> dict[str, object]:
        caches = token_caches(*paths)
        found = [measure_text(t or "", *caches) for t in texts.to_pylist()]
        return dict(zip(names, zip(*found) if found else [[]] * len(names)))

    return df.select(*keep, measures(df, F.col(text), work, made, MEASURED_ROWS).alias("MEASURED"))


def language_bands(measured: DataFrame, language: str) -> DataFrame:
    """Centre and spread of each measure over all of a language's texts that pass the base rules.

    The centre is the median, the spread the distance of the quartiles as a standard deviation, with a floor and, from
    the quartile away from the limit, a ceiling. Quantile sketches are merged before the shuffle, so that a language with most of the rows is no large group. A language whose texts all
    fail the base rules has no band, and needs none.
    """
    parts = [F.percentile_approx(name, [0.25, 0.5, 0.75], 5000).alias(name) for name in BANDS]
    bands = measured.where(~base_failed()).groupBy(F.col(language).alias("BAND")).agg(*parts)

    def spread(name: str) -> Column:
        low, centre, high = (F.col(name)[i] for i in range(3))
        away = high - centre if BANDS[name][0] is not None else centre - low
        return F.greatest(F.least((high - low) / 1.349, away * 2 / 1.349 * MOST_SPREAD), F.lit(LEAST_SPREAD[name]))

    columns = [c for n in BANDS for c in (F.col(n)[1].alias(f"{n}_centre"), spread(n).alias(f"{n}_spread"))]
    return bands.select("BAND", *columns)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def beyond_limit(name: str) -> Column:
    """Whether a measure is one that no ordinary text has, whatever the other texts of its language are."""
    if name == "byte_share":
        return F.col(name) > BYTE_LIMIT
    if name == "token_entropy":
        return F.col(name) < ENTROPY_LIMIT
    code = F.lower(F.substring_index(F.translate("LANGUAGE", "_", "-"), "-", 1))
    latin = F.col("WORD_BYTES") < LATIN_BYTES * F.col("word_chars")
    least = F.when(latin, LATIN_LIMIT).otherwise(OTHER_LIMIT)
    for language, limit in LANGUAGE_LIMITS.items():
        least = F.when(code == language, limit).otherwise(least)
    return F.col(name) < least


def quality_rules(df: DataFrame, keep: list[str], language: str = "lang", text: str = "text") -> DataFrame:
    """The columns ``keep``, the measures, ``base_failed``, the first ``reason`` against a text, and ``kept``.

    A text goes if it fails a base rule, or if a vocabulary fits it much worse than its language: few characters a
    token, many byte fallbacks, or few different tokens, beyond a band around the language's median over the whole
    corpus, or beyond a fixed limit, which also holds for a language of one text or of garbage only. Null and empty texts have no words and fail. Texts without a language are a language of their own. Repeated
    rows get the same verdict; an empty table gives no row.
    """
    marked = df.select(*keep, F.coalesce(F.col(language), F.lit("")).alias("LANGUAGE"), F.col(text).alias("TEXT"))
    written = materialise_texts(measure_texts(marked, [*keep, "LANGUAGE"], "TEXT"), "measured")
    measured = written.select(*keep, "LANGUAGE", "MEASURED.*")
    # A written table of a few rows has a known size, so that the texts are joined with it where they are.
    bands = materialise(language_bands(measured, "LANGUAGE"), "bands")
    joined = measured.join(bands, F.col("LANGUAGE") == F.col("BAND"), "left")
    steady = F.sqrt(F.least(F.lit(1.0), F.col("n_tokens") / STEADY_TOKENS))
    reason = F.when(base_failed(), "base rules")
    for name, (low, high) in BANDS.items():
        z = (F.col(name) - F.col(f"{name}_centre")) / F.col(f"{name}_spread") * steady
        beyond = z < low if low is not None else z > high
        reason = reason.when(beyond | beyond_limit(name), name)
    measures = [part.split()[0] for part in MEASURES.split(", ")]
    out = joined.select(*keep, *measures, base_failed().alias("base_failed"), reason.alias("reason"))
    return out.withColumn("kept", F.col("reason").isNull())
