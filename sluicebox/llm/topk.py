"""Exact search for the greatest inner products over an index of posting segments by descending impact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches, schema_of
from sluicebox.session import materialise

SCALE = 64
ROWS, QUERIES = 8192, 1024
#: Impacts are quantised to so many levels, each a segment.
LEVELS = 6
MOST_TASKS = 10_000
FOUND = "query_id long, query_row long, vec_id long, vec_row long, score long"


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """The components as whole numbers, null if the vector or one of its components is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    return F.when(embedding.isNotNull() & ~bad, whole)


class ImpactIndex:
    """The postings of a block of vectors by descending impact.

    A posting is a component of a vector, its impact the component's size. A segment holds the postings of one impact
    level of all vectors and dimensions; ``rest`` has, after each segment, the length of what is left of each vector.
    """

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        size = np.abs(vectors)
        width = max(1.0, float(size.max(initial=0.0)) + 1.0) / levels
        level = np.floor(size / width)
        self.segments, self.rest = [], []
        for step in range(levels - 1, -1, -1):
            self.segments.append(np.where(level == step, vectors, 0.0))
            self.rest.append(np.sqrt((np.where(level < step, vectors, 0.0) ** 2).sum(axis=1)))

    def possible(self, queries: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """For each query, which vectors may be among its ``k`` greatest; ``own`` marks those that take no part.

        Scores grow segment by segment. By the Cauchy-Schwarz inequality, what is left changes a score by the query's
        length times that of the rest of the vector at most. A vector is ruled out once its greatest possible score is
        below the k-th of the least possible ones. The segments end early only when few are left for every query.
        """
        count = len(self.vectors)
        scores = np.zeros((len(queries), count))
        scores[own] = -np.inf
        lengths = np.sqrt((queries**2).sum(axis=1))[:, None]
        left = ~own
        if count <= k:
            return left
        for segment, rest in zip(self.segments, self.rest):
            scores += queries @ segment.T
            margin = lengths * rest * (1 + 1e-9)
            least = np.partition(scores - margin, count - k, axis=1)[:, count - k]
            left = ~own & (scores + margin >= least[:, None])
            if left.sum(axis=1).max() <= max(2 * k, count // 64):
                break
        return left


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where that is exact, else by Python's whole numbers."""
    most = float(np.abs(vectors).max(initial=0.0)) * float(np.abs(query).max(initial=0.0)) * max(1, len(query))
    if most < 2**53:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in vectors], dtype=object)


def best(scores: np.ndarray, ids: list, rows: np.ndarray, k: int) -> list[int]:
    """Places of the ``k`` greatest scores, ties by id, null ids last, then by row."""
    return sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j] is None, ids[j] or 0, rows[j]))[:k]


def blocks(rows: DataFrame, count: int, name: str) -> DataFrame:
    """Blocks of about equally many rows, by a hash of the row number, so that equal vectors are spread."""
    number = F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    member = F.struct("vec_id", "row", "vector")
    return rows.groupBy(number.alias(name)).agg(F.collect_list(member).alias(f"{name}_rows"))


def unpack(rows: pa.StructScalar) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, row numbers and vectors of a block."""
    members = rows.values
    ids = members.field("vec_id").to_pylist()
    vectors = members.field("vector")
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return ids, members.field("row").to_numpy(), matrix


def top_products(
    df: DataFrame, wanted: Column, k: int = 20, key: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """The ``k`` greatest integer inner products of each row that ``wanted`` marks with all other rows.

    Vectors are compared with those of the same number of dimensions. Both sides are cut into blocks of bounded size,
    and each block of queries meets each block of vectors in a task of its own; a task gives ``k`` rows a query at most,
    which are cut to ``k`` again before they are shuffled. Ties go to the smaller key, null keys last, then by row.
    Vectors that are null or empty, or hold null or non-finite components, take no part; of repeated rows each is a
    candidate for the other. An empty table gives no row.
    """
    vectors = df.select(
        F.col(key).cast("long").alias("vec_id"),
        quantised(F.col(embedding)).alias("vector"),
        F.coalesce(wanted, F.lit(False)).alias("wanted"),
    ).where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    rows = materialise(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("wanted").cast("long")).alias("q")
    )
    found = None
    for size in sizes.where("q > 0").collect():
        part = search(rows.where(F.size("vector") == size["d"]), size["n"], size["q"], k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("vec_row")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, n: int, q: int, k: int) -> DataFrame:
    """Each block of vectors against each block of queries: ``k`` rows for each query and block."""
    n_rows, n_queries = -(-n // ROWS), -(-q // QUERIES)
    left = blocks(rows, n_rows, "part").withColumn(
        "query", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))
    )
    pairs = left.join(blocks(rows.where("wanted"), n_queries, "query"), "query")
    dealt = pairs.repartition(min(n_rows * n_queries, MOST_TASKS), "part", "query")
    arrow = schema_of(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, numbers, matrix = unpack(batch.column("part_rows")[at])
                query_ids, query_rows, queries = unpack(batch.column("query_rows")[at])
                own = query_rows[:, None] == numbers[None, :]
                left = ImpactIndex(matrix).possible(queries, k, own)
                out: list[tuple] = []
                for i, possible in enumerate(left):
                    members = np.flatnonzero(possible)
                    scores = exact_scores(matrix[members], queries[i])
                    for j in best(scores, [ids[m] for m in members], numbers[members], k):
                        m = members[j]
                        out.append((query_ids[i], int(query_rows[i]), ids[m], int(numbers[m]), int(scores[j])))
                columns = zip(*out) if out else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
                )

    return map_batches(dealt.select("part_rows", "query_rows"), run, FOUND)
