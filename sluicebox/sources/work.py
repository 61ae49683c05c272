"""What a run has finished, kept for its repetition."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.dates import day_path, under
from sluicebox.sources.layout import create_file, path_exists, read_file


def input_prints(spark: SparkSession, root: str, day: str, hours: Sequence[str]) -> dict[str, str]:
    """For each hour a print of the names, lengths and times of its raw files; content is not read.

    The files are listed and summed up by Spark, so that an hour of many files sends one row to the driver.
    """
    places = [under(root, day_path(day), hour) for hour in hours]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(places)
    mark = F.xxhash64("path", "length", "modificationTime")
    hour = F.regexp_extract("path", f".*/{day_path(day)}/([0-9]{{2}})/", 1)
    sums = files.select(hour.alias("HOUR"), mark.alias("MARK"), "length").groupBy("HOUR")
    found = sums.agg(
        F.count("MARK").alias("files"), F.sum("length").alias("bytes"), F.bit_xor("MARK").alias("marks"),
        F.sum(F.col("MARK").cast("decimal(38,0)")).alias("total"),
    )
    prints = {row["HOUR"]: f"{row['files']}/{row['bytes']}/{row['marks']}/{row['total']}" for row in found.collect()}
    return {hour: prints.get(hour, "none") for hour in hours}


class Work:
    """A folder of finished steps: each has a small file, named by what the step depends on, that says what it made.

    The file is written after the step's own output, which has a name of its own; a step that was cut off has none and is
    done again. One run at a time uses a folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @staticmethod
    def _name(step: str, depends: object) -> str:
        digest = hashlib.sha256(json.dumps(depends, sort_keys=True).encode()).hexdigest()[:32]
        return f"{step}.{digest}.json"

    def find(self, step: str, depends: object) -> dict | None:
        name = self._name(step, depends)
        if not path_exists(self.spark, under(self.folder, name)):
            return None
        return json.loads(read_file(self.spark, self.folder, name))

    def finish(self, step: str, depends: object, made: dict) -> None:
        create_file(self.spark, self.folder, self._name(step, depends), json.dumps(made))
