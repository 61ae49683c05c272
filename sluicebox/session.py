"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Event fields that differ only in case are different columns.
    "spark.sql.caseSensitive": "true",
    "spark.sql.parquet.mergeSchema": "false",
    # Hot event types are divided at run time.
    "spark.sql.adaptive.enabled": "true",
    # The JVM does not compile methods above 8000 bytes, and a select of a few hundred columns makes such methods.
    # With this limit Spark generates several small ones for them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_local_scratch: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings every job here relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str) -> SparkSession:
    """Session for a job started from the command line; cluster settings come from spark-submit."""
    return configure(SparkSession.builder.appName(app_name).getOrCreate())


@contextmanager
def sql_settings(spark: SparkSession, **values: object):
    """Set SQL settings for one block; keys use ``__`` for dots."""
    keys = {name.replace("__", "."): str(value) for name, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def scratch_path(spark: SparkSession, label: str, root: str | None = None) -> str:
    """A new path under ``root``, by default in the folder that all executors share.

    The folder is ``spark.checkpoint.dir``. Only a local session may do without that setting; it gets a
    temporary folder, which driver and tasks share because they are one process; it is removed when that ends.
    """
    global _local_scratch
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="sluicebox-")
            atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
        root = _local_scratch
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """Write a derived table to the scratch folder, or below ``root``, and read it back.

    The result survives lost executors, is computed once however often it is used, and has a known size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label, root)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
