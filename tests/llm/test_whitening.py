"""Whitening against plain sums over all rows in whole numbers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import sluicebox.llm.whitening as whitening
from sluicebox.llm.whitening import scatter, whiten

ENTRY = st.integers(-9, 9) | st.integers(-(2**63), 2**63 - 1)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 4).flatmap(lambda d: st.lists(st.lists(ENTRY, min_size=d, max_size=d), min_size=1, max_size=70)))
def test_bit_planes_give_exact_sums(rows):
    sums, squares = scatter(np.array(rows, np.int64))
    d = len(rows[0])
    assert sums == [sum(r[i] for r in rows) for i in range(d)]
    assert squares == [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]


def by_definition(rows):
    """Rows that take part, their count, sums and exact covariance, over each different vector once."""
    real = [
        (k, [min(max(math.floor(256 * x), -(2**63)), 2**63 - 1) for x in v])
        for k, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    size = max((len(x) for _, x in real), default=0)
    real = [(k, x + [0] * (size - len(x))) for k, x in real]
    fit = [list(x) for x in {tuple(x) for _, x in real}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[Fraction(n * a - s, n) for a, s in zip(x, sums)] for x in fit]
    covariance = [[float(sum(c[i] * c[j] for c in centred) / n) for j in range(size)] for i in range(size)]
    return real, n, sums, np.array(covariance)


def check(got, rows, count=4):
    real, n, sums, covariance = by_definition(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors.T[::-1]
    count = min(count, len(sums))
    assert len(got) == len(real) * count
    deviation = sorted((str(k), c, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for k, x in real for c in range(1, count + 1))
    assert sorted((str(r.vec_id), r.component, int(r.deviation)) for r in got) == deviation
    for c in range(1, count + 1):
        share = values[c - 1] / np.trace(covariance)
        of = [r for r in got if r.component == c]
        assert all(r.n == n and abs(r.explained - share) < 1e-9 for r in of)
        axis = vectors[c - 1] / np.sqrt(values[c - 1])
        made = sorted((str(k), float(np.dot([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums)], axis))) for k, x in real)
        found = sorted((str(r.vec_id), r.whitened) for r in of)
        off = [
            max(abs(a - b) for (_, a), (_, b) in zip(made, sorted((k, sign * w) for k, w in found))) for sign in (1, -1)
        ]
        assert min(off) < 1e-6
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4


@pytest.mark.parametrize("block", [1 << 14, 17])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.1 + d / 20) + 3 for d in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(75)] + [(3, rows[3][1]), (4, rows[4][1])]
    rows += [(900, None), (901, [1.0, None] * 3), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, [-0.0] * 6)]
    df = spark.createDataFrame([(k, v, 0.5) for k, v in rows], "vec_id long, embedding array<double>, whitened double")
    found = whiten(df.repartition(4), ["vec_id"])
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), rows)


def test_lengths_differ_and_keys_are_missing(spark):
    rng = random.Random(12)
    rows = [(None if i % 7 == 0 else i, [rng.uniform(-1, 1) for _ in range(1 + i % 3)]) for i in range(60)] + [(99, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whiten(df, ["vec_id"]).collect()
    real = by_definition(rows)[0]
    assert len(found) == 3 * len(real) and sorted(r.component for r in found if r.vec_id is None)[:9] == [1] * 9


def test_huge_entries(spark):
    rows = [(1, [1e17, 0.5]), (2, [-3e38, 0.25]), (3, [2e15, 0.125]), (4, [3e38, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whiten(df, ["vec_id"]).collect()
    real, n, sums, _ = by_definition(rows)
    exact = {k: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for k, x in real}
    assert {r.vec_id: r.deviation for r in found} == {k: v if v < 10**38 else None for k, v in exact.items()}
    assert found[0].identity_error < 1e-4


def test_no_variance_and_no_rows(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0]), (1, [0.5, 2.0]), (2, None)], "vec_id long, embedding array<float>")
    found = whiten(df, ["vec_id"]).collect()
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in found) == [
        (1, c, 1, 0, 0.0, 0.0, 0.0) for c in (1, 1, 2, 2)
    ]
    for table in (df.limit(0), df.where("vec_id = 2"), spark.createDataFrame([(1, [])], df.schema)):
        none = whiten(table, ["vec_id"])
        assert none.columns[0] == "vec_id" and none.count() == 0


def test_query_over_the_table(spark):
    from sluicebox.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    found = QUERIES["op11_bit_sliced_whitening"](spark, folder)
    assert dict(found.dtypes)["deviation"] == "bigint"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(found.collect(), rows)
