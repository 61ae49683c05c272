"""Directory names of partitions, and moving finished partitions to their published place."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from sluicebox.functions.dates import under

# What Spark writes for an empty partition value, and the characters it escapes in others.
EMPTY_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def escape_value(value: str) -> str:
    """A partition value as Spark spells it in a directory name."""
    return _ESCAPED.sub(lambda match: f"%{ord(match[0]):02X}", value) or EMPTY_VALUE


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, to_path = _file_system(spark, path)
    return fs.exists(to_path(path))


def glob_exists(spark: SparkSession, pattern: str) -> bool:
    fs, to_path = _file_system(spark, pattern)
    return bool(fs.globStatus(to_path(pattern)))


def list_glob(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern."""
    fs, to_path = _file_system(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(to_path(pattern)) or []]


def remove_tree(spark: SparkSession, path: str) -> None:
    fs, to_path = _file_system(spark, path)
    fs.delete(to_path(path), True)


def publish_partitions(
    spark: SparkSession, staged: str, target: str, columns: Sequence[str], concurrent: int = 16
) -> list[str]:
    """Move staged ``*/a=1/b=2`` directories to ``target/1/2``, replacing what is there.

    Called after all staged jobs succeeded. Staging and target share a file system, so a move is a rename. A repeat
    of the whole run replaces the same directories again.
    """
    fs, to_path = _file_system(spark, staged)
    pattern = under(staged, "*", *[f"{column}=*" for column in columns])
    found = [status.getPath() for status in fs.globStatus(to_path(pattern)) or []]

    def move(source) -> str:
        names, node = [], source
        for _ in columns:
            names.insert(0, node.getName().split("=", 1)[1])
            node = node.getParent()
        place = under(target, *names)
        destination = to_path(place)
        fs.delete(destination, True)
        fs.mkdirs(destination.getParent())
        if not fs.rename(source, destination):
            raise OSError(f"could not move {source} to {place}")
        return place

    with ThreadPoolExecutor(concurrent) as pool:
        return sorted(pool.map(move, found))


def remove_stale(spark: SparkSession, target: str, hours: Sequence[str], kept: Sequence[str]) -> None:
    """Remove ``target/*/hour`` for the given hours unless it is among the directories kept."""
    fs, to_path = _file_system(spark, target)
    keep = {to_path(path).toUri().getPath() for path in kept}
    for hour in hours:
        for status in fs.globStatus(to_path(under(target, "*", hour))) or []:
            if status.getPath().toUri().getPath() not in keep:
                fs.delete(status.getPath(), True)


# Files in a day's folder that say which run holds each hour; the one with the highest number holds.
CURRENT = "_current"
# The file in a run's folder that its writer touches, and how long a run without a switch stays after the last touch.
LEASE = "_lease"
LEASE_SECONDS = 24 * 3600
# Manifests, and the runs that they name, that stay for readers.
KEPT_MANIFESTS = 2


def _numbered(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the manifests of a folder, in order."""
    fs, to_path = _file_system(spark, folder)
    found = [status.getPath().getName() for status in fs.globStatus(to_path(under(folder, f"{CURRENT}.*"))) or []]
    return sorted(int(number) for name in found if (number := name.rsplit(".", 1)[1]).isdigit())


def read_file(spark: SparkSession, folder: str, name: str) -> str:
    fs, to_path = _file_system(spark, folder)
    stream = fs.open(to_path(under(folder, name)))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _read_manifest(spark: SparkSession, folder: str, number: int) -> dict[str, str]:
    return json.loads(read_file(spark, folder, f"{CURRENT}.{number}"))


def read_current(spark: SparkSession, folder: str) -> dict[str, str]:
    """The run of each hour; empty if the folder has no runs."""
    numbers = _numbered(spark, folder)
    return _read_manifest(spark, folder, numbers[-1]) if numbers else {}


def _create_manifest(spark: SparkSession, folder: str, number: int, runs: dict[str, str]) -> bool:
    """Write a manifest unless its number is taken."""
    return create_file(spark, folder, f"{CURRENT}.{number}", json.dumps(runs, sort_keys=True))


def create_file(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Write a file unless it exists: a whole file gets the name by a rename that does not overwrite."""
    fs, to_path = _file_system(spark, folder)
    fresh, taken = to_path(under(folder, f"_new.{uuid.uuid4().hex}")), to_path(under(folder, name))
    stream = fs.create(fresh)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(fresh), fs.makeQualified(taken), how)
    except Py4JJavaError as error:
        fs.delete(fresh, False)
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def switch_current(spark: SparkSession, folder: str, hours: Iterable[str], run: str) -> None:
    """Make ``run`` current for its hours in one step; the other hours stay with the runs that hold them.

    Runs that end at the same time agree by the numbers of their manifests: a number is given once, and who finds it
    taken reads what is current now and tries the next one. The folder of the run must still be there.
    """
    hours = list(hours)
    while True:
        if not path_exists(spark, under(folder, run)):
            raise FileNotFoundError(f"{under(folder, run)} is gone; nothing was published")
        numbers = _numbered(spark, folder)
        before = _read_manifest(spark, folder, numbers[-1]) if numbers else {}
        if _create_manifest(spark, folder, (numbers or [0])[-1] + 1, {**before, **dict.fromkeys(hours, run)}):
            return


def touch_lease(spark: SparkSession, run_folder: str) -> None:
    """Say that a run is being written."""
    fs, to_path = _file_system(spark, run_folder)
    path = to_path(under(run_folder, LEASE))
    if not fs.createNewFile(path):
        fs.setTimes(path, int(time.time() * 1000), -1)


def _abandoned(spark: SparkSession, run_folder: str, seconds: float) -> bool:
    fs, to_path = _file_system(spark, run_folder)
    lease = to_path(under(run_folder, LEASE))
    last = fs.getFileStatus(lease if fs.exists(lease) else to_path(run_folder)).getModificationTime()
    return time.time() * 1000 - last > seconds * 1000


def remove_runs(spark: SparkSession, folder: str, lease_seconds: float = LEASE_SECONDS) -> None:
    """Remove what readers no longer need: older manifests, and the runs that only these name.

    A run that no manifest names may still be written; it goes when its lease is older than ``lease_seconds``.
    """
    fs, to_path = _file_system(spark, folder)
    numbers = _numbered(spark, folder)
    named = {}
    for number in numbers:
        try:
            named[number] = set(_read_manifest(spark, folder, number).values())
        except Py4JJavaError:  # another run has removed it just now
            continue
    kept = set().union(*(named[n] for n in numbers[-KEPT_MANIFESTS:] if n in named))
    old = set().union(*named.values()) - kept
    for status in fs.globStatus(to_path(under(folder, "run-*"))) or []:
        name = status.getPath().getName()
        if name in kept:
            continue
        if name in old or _abandoned(spark, under(folder, name), lease_seconds):
            fs.delete(status.getPath(), True)
    for number in numbers[:-KEPT_MANIFESTS]:
        fs.delete(to_path(under(folder, f"{CURRENT}.{number}")), False)
