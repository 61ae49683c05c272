"""Toxicity by compression distance: two zstandard dictionaries compete for the windows of a text."""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import map_texts
from sluicebox.llm.logistic import Logistic, fit_logistic
from sluicebox.llm.tokens import WordCache

#: The model is fitted on so many labelled texts at most, of either kind half if there are as many; within a kind they are
#: chosen by a hash of their keys.
FIT_TEXTS = 4000
#: A window is a word, or a part of so many characters of a longer one; the windows cover the whole text.
WINDOW = 24
#: zstandard begins no match in the last eight bytes, so each window ends with these.
MARGIN = b"\n" * 8
TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 1 << 15, 1 << 15, 3
#: A word speaks for a class if it has so many different neighbours there, and so many times more of them.
CONTEXTS, ODDS = 4, 10.0
#: Windows of the ordinary dictionary and of the cells' evidence.
ORDINARY_WINDOWS = 100_000
#: Thresholds on the evidence of a window, to choose from: what counts at all, and what counts as a hit.
SOME, HIT = (0.7, 1.2), (1.5, 2.0, 2.5, 3.0, 3.5)
#: The calibration looks at texts whose own labels had no part in the evidence: so many parts take turns.
FOLDS = 4

Cell = tuple[int, int, int]


class ToxicityModel(NamedTuple):
    """Two dictionaries, the evidence of each pair of compressed lengths, the thresholds, and a text's calibration."""

    toxic: bytes
    ordinary: bytes
    evidence: dict[Cell, float]
    some: float
    hit: float
    calibration: Logistic


def windows(text: str) -> list[str]:
    """The windows of a text in lower case."""
    words = text.lower().split()
    if not any(len(w) > WINDOW for w in words):
        return words
    return [w[i : i + WINDOW] for w in words for i in range(0, len(w), WINDOW)]


def framed(window: str) -> bytes:
    return b" " + window.encode() + b" " + MARGIN


class Lengths:
    """The cell of a window: its length in bytes, and by how many bytes it differs under either dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.toxic, self.ordinary = (
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **plain).compress
            for d in (toxic, ordinary)
        )

    def __call__(self, window: str) -> Cell:
        body = framed(window)
        toxic, ordinary = len(self.toxic(body)), len(self.ordinary(body))
        return min(WINDOW, len(body) - len(MARGIN)), toxic - len(body), ordinary - toxic


def telling_words(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Words that speak for toxic texts, by the number of different neighbours that they have there.

    Copies of a text repeat a word with the same neighbours and so add nothing. Neighbours are only looked at for words
    of CONTEXTS toxic texts or more.
    """
    bare = lambda word: word.strip(".,;:!?\"'")
    often = Counter(w for t in toxic for w in {bare(w) for w in t.lower().split()})
    wanted = {w for w, n in often.items() if n >= CONTEXTS and w}
    seen: list[dict[str, set]] = []
    sizes = []
    for texts in (toxic, ordinary):
        contexts: dict[str, set] = defaultdict(set)
        total = 0
        for text in texts:
            words = ["", *map(bare, text.lower().split()), ""]
            total += len(words)
            for before, word, after in zip(words, words[1:], words[2:]):
                if word in wanted and len(contexts[word]) < 50_000:
                    contexts[word].add(hash((before, after)))
        seen.append(contexts)
        sizes.append(total)
    scale = sizes[1] / sizes[0]
    return {
        w
        for w, c in seen[0].items()
        if len(c) >= CONTEXTS and len(c) * scale >= ODDS * (len(seen[1].get(w, ())) + 1)
    }


def fit_toxicity(texts: list[str], labels: list[int], odds: float = 0.0) -> ToxicityModel:
    """Dictionaries, evidence and calibration from labelled texts.

    ``odds`` are the log odds of a toxic text among all labels beyond those among ``labels``; they go to the calibration.

    A toxic text is ordinary in most places, so the toxic dictionary holds the windows of toxic texts whose word speaks
    for them, the most frequent last, where matches are cheapest. The ordinary dictionary is trained on windows of the
    other texts. The evidence of a cell is how much more often windows of toxic texts fall into it. The thresholds are
    those whose calibration fits best texts that had no part in the evidence.
    """
    import zstandard

    cut = [windows(t) for t in texts]
    toxic = [t for t, y in zip(texts, labels) if y]
    words = telling_words(toxic, [t for t, y in zip(texts, labels) if not y])
    chosen = Counter(w for ws, y in zip(cut, labels) if y for w in ws if w.strip(".,;:!?\"'") in words)
    ranked = sorted(chosen, key=lambda w: (chosen[w], w))
    toxic_bytes = b"".join(map(framed, ranked))[-TOXIC_BYTES:] or MARGIN
    plain = [w for ws, y in zip(cut, labels) if not y for w in ws]
    samples = [framed(w) for w in plain[:: max(1, len(plain) // ORDINARY_WINDOWS)]]
    try:
        ordinary_bytes = zstandard.train_dictionary(ORDINARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few windows to train on: they are the dictionary
        ordinary_bytes = b"".join(samples)[-ORDINARY_BYTES:] or MARGIN
    cells = WordCache(Lengths(toxic_bytes, ordinary_bytes), 500_000)
    counted = [Counter(cells[w] for w in ws) for ws in cut]
    y = np.array(labels, float)
    fold = np.empty(len(y), np.int64)
    for kind in (0, 1):  # each part gets as many texts of either kind
        fold[y == kind] = np.arange((y == kind).sum()) % FOLDS
    known = [cell_evidence(counted, y, fold != part) for part in range(FOLDS)]
    values = [
        np.array([known[part].get(cells[w], 0.0) for w in ws]) for ws, part in zip(cut, fold)
    ]
    fits = []
    for some in SOME:
        for hit in HIT:
            model, loss = fit_logistic(np.array([features(v, some, hit) for v in values]), y)
            fits.append((loss, some, hit, model))
    _, some, hit, calibration = min(fits, key=lambda f: f[:3])
    calibration = calibration._replace(weights=(calibration.weights[0] + odds, *calibration.weights[1:]))
    evidence = {c: v for c, v in cell_evidence(counted, y, fold >= 0).items() if v >= some}
    return ToxicityModel(toxic_bytes, ordinary_bytes, evidence, some, hit, calibration)


def cell_evidence(counted: list[Counter], y: np.ndarray, chosen: np.ndarray) -> dict[Cell, float]:
    """How much more often, as a logarithm, windows of the chosen toxic texts fall into a cell than other windows."""
    counts = Counter(), Counter()
    for found, label, use in zip(counted, y, chosen):
        if use:
            counts[int(label)].update(found)
    totals = [max(1, sum(c.values())) for c in counts]
    prior = 2 * max(1.0, 1e5 / min(totals))
    share = lambda kind, cell: prior + counts[kind][cell] * 1e5 / totals[kind]
    return {cell: float(np.log(share(1, cell) / share(0, cell))) for cell in {*counts[0], *counts[1]}}


def features(values: np.ndarray, some: float, hit: float) -> tuple:
    """The evidence above either threshold, as a whole and as a share of the text, in logarithms."""
    size, hits, total = len(values) + 6, float((values >= hit).sum()), float(values[values >= some].sum())
    return np.log1p(total), np.log((total + 0.05) / size), np.log1p(hits), np.log((hits + 0.05) / size)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, held_in: Column, rows: int = FIT_TEXTS
) -> tuple[DataFrame, float]:
    """Texts and labels of ``rows`` labelled keys at most, and the log odds that the labels have beyond the sample's.

    Several labels of a key are averaged. Each kind has half of the rows, and what the other one does not fill, so that
    a rare kind is not left out; within a kind the first by a hash are taken.
    """
    mean = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & held_in)
    keys = mean.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("LABEL"))
    counts = {r["LABEL"]: r["n"] for r in keys.groupBy("LABEL").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [counts.get(kind, 0) for kind in (0, 1)]
    ones = min(n[1], max(rows // 2, rows - n[0]))
    take = [min(n[0], rows - ones), ones]
    first = [
        keys.where(F.col("LABEL") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take[kind]) for kind in (0, 1)
    ]
    chosen = first[0].unionByName(first[1])
    odds = float(np.log(n[1] / take[1]) - np.log(n[0] / take[0])) if min(take) else 0.0
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "LABEL").agg(F.min("text").alias("text")), odds


def held_out(key: str = "doc_id") -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, ``score`` and ``n_toxic_windows`` of every whole text.

    A null or empty text has no windows and gets the score of a text without toxic ones. Rows are independent; nothing
    is shuffled. The model, two dictionaries of bounded size and a table of at most a few thousand cells, goes to
    the tasks with the function.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    name = uuid.uuid4().hex

    def work(texts: list[str | None]) -> dict[str, object]:
        value = window_evidence(name, model)
        values = [
            np.fromiter(map(value.__getitem__, ws), float, len(ws)) for ws in (windows(t or "") for t in texts)
        ]
        found = np.array([features(v, model.some, model.hit) for v in values]).reshape(-1, 4)
        hits = np.array([(v >= model.hit).sum() for v in values], np.int64)
        return {"score": model.calibration.probability(found), "n_toxic_windows": hits}

    return map_texts(docs, work, f"{kept}, score double, n_toxic_windows long", keep, text)


_cache: dict[str, WordCache] = {}


def window_evidence(name: str, model: ToxicityModel) -> WordCache:
    """The evidence of a window under the model of this name; a Python worker keeps that of one model at a time."""
    if name not in _cache:
        _cache.clear()
        lengths = Lengths(model.toxic, model.ordinary)
        _cache[name] = WordCache(lambda window: model.evidence.get(lengths(window), 0.0))
    return _cache[name]


def classify_toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.7, rows: int = FIT_TEXTS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document; only held-in labels are used.

    Without any held-in label of both kinds there is nothing to learn, and all scores are zero.
    """
    sample, odds = labelled_sample(docs, labels, "toxic", ~held_out(), rows)
    found = sample.select("text", "LABEL").collect()
    if len({r["LABEL"] for r in found}) < 2:
        scored = docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_toxic_windows"))
    else:
        found.sort()
        model = fit_toxicity([r["text"] for r in found], [r["LABEL"] for r in found], odds)
        scored = score_toxicity(docs, model, ["doc_id"])
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return scored.select("doc_id", out, "score", (F.col("score") >= least).cast("int").alias("predicted"), "n_toxic_windows")
