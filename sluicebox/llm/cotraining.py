"""Text quality by co-training: a classifier of the text and one of the page's metadata teach each other."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import discard, list_array, map_batches, materialise_texts, measures
from sluicebox.llm.fertility import SPACES, repeated_lines, repeated_words
from sluicebox.session import materialise

ROUNDS, STEPS = 3, 4
#: A view teaches the other one what it is so sure of; each such row counts as this share of a labelled one.
SURE, PSEUDO_WEIGHT = 0.97, 0.2
RIDGE = 1.0
#: Documents below this probability of good quality are rejected.
LEAST_SCORE = 0.5
LANGUAGES, SOURCES = 8, 16
#: So many texts are looked at before their features go on.
FEATURED_ROWS = 200
#: Features count up to so many standard deviations, log odds of a view up to so much.
MOST_DEVIATIONS, MOST_MARGIN = 8, 12

VIEWS = ("content", "meta")
MARGINS = ("content_margin", "meta_margin")


class View(NamedTuple):
    """A logistic classifier on standardised features; the first weight is the constant."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((np.ones(len(x)), np.clip((x - self.centre) / self.spread, -MOST_DEVIATIONS, MOST_DEVIATIONS)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def content_features(text: str) -> list[float]:
    """What the words are like: symbols, cases, repetition, lengths. All are shares or logarithms."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text) - sum(map(text.count, SPACES)))
    counts = Counter(words)
    letters = max(1, sum(map(str.isalpha, text)))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:?)\"'" for w in words)
    follow = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(len(words)),
        len(counts) / n,
        np.log(len(counts) + 1.0) / np.log(n + 2.0),
        max(counts.values(), default=0) / n,
        sum(map(text.count, "#*$%&|<>")) / chars,
        text.count("!") / chars,
        upper / letters,
        digits / chars,
        marked / n,
        follow / n,
        repeated_words(text.encode().split()) / n,
        (chars - letters - digits) / chars,
        chars / n,
    ]


def meta_features(text: str, language: str | None, source: str | None, chars: int | None) -> list[float]:
    """What is known of the page besides its words: language, source, length and layout."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    of = lambda value, size: [float(i == xxhash.xxh32_intdigest(value or "") % size) for i in range(size)]
    return [
        np.log1p(max(0, chars or 0)),
        np.log1p(len(lines)),
        np.log1p(len(text) / max(1, len(lines))),
        repeated_lines(text) / max(1, len(lines)),
        *of(language, LANGUAGES),
        *of(source, SOURCES),
    ]


def view_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and, in ``VIEWS``, the features of both views. ``lang``, ``source``, ``n_chars`` may be null."""
    inputs = F.struct(
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )

    def work(pages: pa.StructArray) -> dict[str, object]:
        texts, *others = (pages.field(i).to_pylist() for i in range(4))
        return {
            "content": list_array([np.array(content_features(t)) for t in texts], pa.float64()),
            "meta": list_array([np.array(meta_features(*e)) for e in zip(texts, *others)], pa.float64()),
        }

    views = measures(docs, inputs, work, "content array<double>, meta array<double>", FEATURED_ROWS)
    return docs.select(*keep, views.alias("VIEWS"))


def matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1) if rows else np.zeros((0, 1))


def sums(rows: DataFrame, count) -> np.ndarray:
    """The sum over all rows of what ``count`` makes of content, meta and labels (-1: none) of a batch.

    Each task adds up its own rows; the vectors, as many as there are tasks, are added up by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (matrix(batch.column(v), batch.num_rows) for v in VIEWS)
            part = count(a, b, batch.column("LABEL").to_numpy())
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    made = map_batches(rows.select(*VIEWS, "LABEL"), run, "total array<double>")
    added = made.select(F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(added))
    for row in added:
        out[row["i"]] = row["x"]
    return out


def newton_parts(design: np.ndarray, weights: np.ndarray, y: np.ndarray, case: np.ndarray) -> np.ndarray:
    p = sigmoid(design @ weights)
    gradient = design.T @ (case * (y - p))
    hessian = (design * (case * p * (1 - p))[:, None]).T @ design
    return np.concatenate((gradient, hessian.ravel()))


def newton_step(weights: np.ndarray, parts: np.ndarray) -> np.ndarray:
    d = len(weights)
    ridge = RIDGE * np.eye(d)
    ridge[0, 0] = 1e-6
    step = np.linalg.solve(parts[d:].reshape(d, d) + ridge, parts[:d] - ridge @ weights)
    return weights + step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))


def taught(y: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Labels and weights of rows: their own label, else what the other view is sure of."""
    own = y >= 0
    if other is None:
        return np.where(own, y, 0.0), own.astype(float)
    p = sigmoid(other)
    sure = ~own & ((p >= SURE) | (p <= 1 - SURE))
    return np.where(own, y, p >= 0.5).astype(float), np.where(own, 1.0, PSEUDO_WEIGHT * sure)


def fit_views(rows: DataFrame) -> tuple[View, View, np.ndarray] | None:
    """Both views after all rounds and the weights that combine them; None without labels of both kinds.

    ``rows`` has the features of all documents and ``LABEL``, -1 where none is given. In the first round each view
    learns from labels alone, later also from what the other one was sure of at the end of the round before, over all
    documents. At last both log odds are calibrated together on the labelled rows.
    """

    def moments(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
        counts = [len(y), (y == 0).sum(), (y == 1).sum()]
        return np.concatenate([counts, a.sum(0), (a**2).sum(0), b.sum(0), (b**2).sum(0)])

    found = sums(rows, moments)
    if not len(found) or not found[1] or not found[2]:
        return None
    n, parts = found[0], found[3:]
    sizes = len(content_features("")), len(meta_features("", None, None, None))
    views = []
    for d in sizes:
        mean, square, parts = parts[:d] / n, parts[d : 2 * d] / n, parts[2 * d :]
        spread = np.sqrt(np.maximum(square - mean**2, 0))
        views.append(View(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros(d + 1)))
    for turn in range(ROUNDS):
        teachers = tuple(views) if turn else None
        for _ in range(STEPS):

            def step(a: np.ndarray, b: np.ndarray, y: np.ndarray, now=tuple(views), by=teachers) -> np.ndarray:
                x = a, b
                out = []
                for i in (0, 1):
                    labels, case = taught(y, by[1 - i].margin(x[1 - i]) if by else None)
                    out.append(newton_parts(now[i].design(x[i]), now[i].weights, labels, case))
                return np.concatenate(out)

            parts = sums(rows, step)
            cut = (sizes[0] + 1) * (sizes[0] + 2)
            views = [
                v._replace(weights=newton_step(v.weights, p)) for v, p in zip(views, (parts[:cut], parts[cut:]))
            ]
    mix = np.array([0.0, 1.0, 0.0])
    for _ in range(STEPS):

        def calibrate(a: np.ndarray, b: np.ndarray, y: np.ndarray, now=tuple(views), w=mix) -> np.ndarray:
            labels, case = taught(y, None)
            return newton_parts(both(now, a, b), w, labels, case)

        mix = newton_step(mix, sums(rows, calibrate))
    return views[0], views[1], mix


def both(views: tuple[View, View], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    margins = (np.clip(v.margin(x), -MOST_MARGIN, MOST_MARGIN) for v, x in zip(views, (a, b)))
    return np.column_stack((np.ones(len(a)), *margins))


def classify_quality(
    docs: DataFrame, labels: DataFrame, keep: list[str], held_in: Column | None = None, label: str = "quality"
) -> DataFrame:
    """The columns ``keep``, ``content_margin``, ``meta_margin``, ``score`` and ``kept`` of every document.

    Labels are joined by ``doc_id``, only where ``held_in`` holds for it; several labels of a key count by their mean.
    Features are worked out once and written; every step of the fit is a sum over all documents, so that nothing is
    gathered but these sums. A null text is empty, null metadata are a value of their own, repeated rows each count.
    Without labels of both kinds all are kept with a score of 1. An empty table gives no row.
    """
    mean = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    mean = mean.where(held_in) if held_in is not None else mean
    mean = mean.groupBy(F.col("doc_id").alias("LABELLED")).agg((F.avg(label) >= 0.5).cast("double").alias("MEAN"))
    keyed = docs.withColumn("LABEL_KEY", F.col("doc_id"))
    written = materialise_texts(view_features(keyed, [*keep, "LABEL_KEY"]), "features")
    featured = written.select(*keep, "LABEL_KEY", "VIEWS.*")
    joined = featured.join(mean, F.col("LABEL_KEY") == F.col("LABELLED"), "left")
    rows = materialise(
        joined.select("LABEL_KEY", *VIEWS, F.coalesce("MEAN", F.lit(-1.0)).alias("LABEL")), "labelled"
    )
    model = fit_views(rows)
    discard(rows)
    if model is None:
        margins, log_odds = [F.lit(0.0), F.lit(0.0)], None
    else:
        margins = [margin_column(view, F.col(name)) for view, name in zip(model[:2], VIEWS)]
        log_odds = F.lit(float(model[2][0])) + sum(F.lit(float(w)) * F.col(n) for w, n in zip(model[2][1:], MARGINS))
    scored = featured.select(*keep, *(m.alias(n) for m, n in zip(margins, MARGINS)))
    score = F.lit(1.0) if log_odds is None else 1 / (1 + F.exp(-clipped(log_odds, 35.0)))
    return scored.withColumn("score", score).withColumn("kept", F.col("score") >= LEAST_SCORE)


def clipped(value: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), value))


def margin_column(view: View, features: Column) -> Column:
    """The clipped log odds of a view as a column expression."""
    total = F.lit(float(view.weights[0]))
    for i, (centre, spread, weight) in enumerate(zip(view.centre, view.spread, view.weights[1:])):
        deviation = (F.get(features, F.lit(i)) - F.lit(float(centre))) / F.lit(float(spread))
        total = total + F.lit(float(weight)) * clipped(deviation, float(MOST_DEVIATIONS))
    return clipped(total, float(MOST_MARGIN))
