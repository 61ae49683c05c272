"""Helpers of the text operators: whole texts as Arrow batches, and gapless numbering without a large group in a task."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicebox.llm.tokens import WordCache
from sluicebox.session import materialise, sql_settings
from sluicebox.sources.layout import remove_tree

TEXT_BATCH_BYTES = 4 << 20
TEXT_ROWS = 1000
#: A filter for semi-joins has at most so many rows of 64 bits, whatever it is made of.
FILTER_WORDS = 1 << 18


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """``mapInArrow`` by a function of this library; a worker that turns to another one forgets its cached words."""
    share_library(df.sparkSession)
    owner = f"{run.__module__}.{run.__qualname__}"

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        WordCache.begin(owner)
        yield from run(batches)
        release_arrow()

    return df.mapInArrow(alone, ddl)


def release_arrow() -> None:
    """Give back what Arrow and the C library keep of freed memory; an idle Python worker would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def share_library(spark: SparkSession) -> None:
    """Let Python workers import this library.

    A cluster gets the library by ``--py-files`` or in its image. The workers of a local session get its folder on their
    path, wherever the session was started.
    """
    context = spark.sparkContext
    if context.master == "local" or context.master.startswith("local["):
        folder, known = str(Path(__file__).resolve().parents[2]), context.environment.get("PYTHONPATH", "")
        if folder not in known.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (folder, known)))


def whole_texts(df: DataFrame, key: str = "doc_id", text: str = "text", *others: str) -> DataFrame:
    """The key, the text (null: empty) and the named columns; whatever else the table holds is left out."""
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text), *others)


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that none has much more than TEXT_BATCH_BYTES of text; a longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)[:-1])) // TEXT_BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def map_texts(
    df: DataFrame,
    work: Callable[[list[str]], dict[str, object]],
    schema: str,
    keep: list[str],
    text: str = "text",
) -> DataFrame:
    """Append the columns that ``work`` makes of a list of whole texts, one value for each, to the columns ``keep``.

    ``schema`` describes the kept columns and then the new ones. Nothing is shuffled.
    """
    arrow = schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            made = work(batch.column(text).to_pylist())
            columns = [batch.column(name) if name in keep else made[name] for name in arrow.names]
            yield pa.RecordBatch.from_arrays(
                [
                    c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                    for c, f in zip(columns, arrow)
                ],
                schema=arrow,
            )

    return map_batches(df.select(*keep, *([] if text in keep else [text])), run, schema)


def measures(df: DataFrame, inputs: Column, work: Callable[[pa.Array], dict[str, object]], schema: str, rows: int) -> Column:
    """A struct of what ``work`` makes of a column, ``rows`` values at a time.

    Only this column goes to Python, and only the struct comes back; the other columns of a row stay where they are.
    """
    share_library(df.sparkSession)
    arrow = schema_of(schema)
    owner = f"{work.__module__}.{work.__qualname__}"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        WordCache.begin(owner)
        for batch in batches:
            parts = []
            for start in range(0, max(1, len(batch)), rows):
                made = work(batch.slice(start, rows))
                columns = [
                    c.cast(f.type) if isinstance(c := made[f.name], pa.Array) else pa.array(c, f.type) for f in arrow
                ]
                parts.append(pa.StructArray.from_arrays(columns, fields=list(arrow)))
            yield pa.concat_arrays(parts)
        release_arrow()

    return F.arrow_udf(run, f"struct<{schema}>")(inputs)


def materialise_texts(df: DataFrame, label: str) -> DataFrame:
    """Write a table that Python makes of whole texts, and read it back.

    Rows go to Python by TEXT_ROWS, as rows with their texts are large and both sides hold a batch.
    """
    with sql_settings(df.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=TEXT_ROWS):
        return materialise(df, label)


def discard(df: DataFrame) -> None:
    """Remove a written table that nothing will read again."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        remove_tree(df.sparkSession, folder)


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a schema string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def list_array(lists: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    offsets = np.fromiter(accumulate((len(x) for x in lists), initial=0), np.int32, len(lists) + 1)
    values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def with_possible(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with POSSIBLE, which is false only if ``table`` has no row with the same ``columns``.

    Rows with large columns need no shuffle to find out that a join would not meet them. The filter sets one of
    64 * FILTER_WORDS bits for each row of ``table``, so that it can be broadcast at any size of the input; the fuller
    it is, the more rows are possible, and a join has to follow for these.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(64 * FILTER_WORDS))
    word, bit = F.shiftright(place, 6).cast("int").alias("WORD"), place.bitwiseAND(F.lit(63)).cast("int").alias("BIT")
    bits = table.select(word, bit).groupBy("WORD").agg(F.expr("bit_or(shiftleft(1L, BIT))").alias("BITS"))
    found = rows.select("*", word, bit).join(F.broadcast(bits), "WORD", "left")
    return found.withColumn("POSSIBLE", F.expr("coalesce(getbit(BITS, BIT) = 1, false)")).select(*rows.columns, "POSSIBLE")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group gaplessly from 0, ordered by ``order``; equal rows are numbered as they stand.

    The rows are sorted over range partitions, so that a group of any size, or a third of all rows being equal, is
    spread over many tasks. A table with one row for each partition and group says where each partition begins.
    Both steps are written to the shared folder: the numbers stay the same when executors are lost. ``group`` columns
    are not null.
    """
    tied = materialise(df.withColumn("TIE", F.monotonically_increasing_id()), "tied")
    sort = [*group, *order, "TIE"]
    spread = tied.repartitionByRange(*sort).sortWithinPartitions(*sort)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(spread.select("*", F.spark_partition_id().alias("PART"), row.alias("ROW")), "placed")
    begins = placed.groupBy(*group, "PART").agg(F.min("ROW").alias("FIRST"), F.count(F.lit(1)).alias("ROWS"))
    before = F.sum("ROWS").over(Window.partitionBy(*group).orderBy("PART").rowsBetween(Window.unboundedPreceding, -1))
    base = begins.select(*group, "PART", (F.coalesce(before, F.lit(0)) - F.col("FIRST")).alias("BASE"))
    joined = placed.join(base, [*group, "PART"])
    return joined.select(*df.columns, (F.col("ROW") + F.col("BASE")).alias(name))
