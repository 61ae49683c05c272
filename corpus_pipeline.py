"""Stages that clean the documents and pack them, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.llm.common import discard, materialise_texts, with_possible
from sluicebox.llm.cotraining import classify_quality
from sluicebox.llm.fertility import quality_rules
from sluicebox.llm.near_duplicates import near_duplicates
from sluicebox.llm.packing import pack_documents
from sluicebox.llm.secret_scan import redact_secrets
from sluicebox.session import materialise

#: Columns of :func:`value_names`.
NAMES = ["NAME", "OTHER"]


def with_page(docs: DataFrame, *columns) -> DataFrame:
    """All columns of a document as one, so that no name can clash, beside those that a stage looks at."""
    return docs.select(F.struct("*").alias("PAGE"), *columns)


def value_names(*columns: str) -> list[Column]:
    """128 bits that name the values of ``columns``. The hash leaves out nulls, so where they are goes in as well."""
    nulls = [F.col(c).isNull() for c in columns]
    return [
        F.xxhash64(*nulls, *columns).alias(NAMES[0]),
        F.xxhash64(*reversed(columns), *nulls).alias(NAMES[1]),
    ]


def passing(docs: DataFrame, judged: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``docs`` that are kept, if ``judged`` has ``NAMES`` and ``kept`` for all values of ``columns``.

    A verdict is that of the values alone, so that repeated rows share it. Only the names of what goes are written;
    the texts are read again instead of being written beside their verdicts. Most rows that are kept pass a filter of
    these names and are not shuffled.
    """
    gone = materialise(judged.where(~F.coalesce("kept", F.lit(False))).select(*NAMES).distinct(), "rejected")
    rows = with_possible(with_page(docs, *value_names(*columns)), gone, NAMES)
    met = rows.where("POSSIBLE").join(gone, NAMES, "left_anti")
    return rows.where("NOT POSSIBLE").select("PAGE").unionByName(met.select("PAGE")).select("PAGE.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the quality rules, which look at the text and its language."""
    columns = "text", "lang"
    judged = quality_rules(docs.select(*value_names(*columns), *columns), NAMES)
    return passing(docs, judged, *columns)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the co-trained classifiers take for good, taught by all labels of what is left.

    The key finds a row's label and has no part in its verdict.
    """
    columns = "text", "lang", "source", "n_chars"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = classify_quality(docs.select(*value_names(*columns), "doc_id", *columns), labels, NAMES)
    return passing(docs, judged, *columns)


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: shingles of five words, a similarity of 0.8 or more.

    A document is named by 64 bits of its key and text, so that no copy of the texts has to be numbered and written.
    Rows that share their name are repeated rows, of which one stays; these alone are brought together. Most rows that
    are kept pass a filter of the other ones' names and are not shuffled.
    """
    name = F.xxhash64("doc_id", "text").alias("NAME")
    found = near_duplicates(docs.select(name, "text"), key="NAME", words=5, percent=80).select("NAME", "kept")
    found = materialise(found, "verdicts")
    gone = found.where("NOT kept").select("NAME").distinct()
    repeated = found.where("kept").groupBy("NAME").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("NAME")
    others = materialise(
        gone.withColumn("first", F.lit(False)).unionByName(repeated.withColumn("first", F.lit(True))), "others"
    )
    rows = with_possible(with_page(docs, name), others, ["NAME"])
    met = rows.where("POSSIBLE").join(others, "NAME", "left")
    first = met.where("first").select("NAME", "PAGE").dropDuplicates(["NAME"])
    kept = rows.where("NOT POSSIBLE").select("PAGE").unionByName(met.where("first IS NULL").select("PAGE"))
    return kept.unionByName(first.select("PAGE")).select("PAGE.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays.

    The rows are written here, as whoever writes them otherwise sends ten thousand texts to Python at once.
    """
    clean = redact_secrets(with_page(docs, "text"), "PAGE")
    new = {"text": F.col("redacted"), "n_chars": F.char_length("redacted").cast("long")}
    return materialise_texts(clean.select(*(new.get(c, F.col(f"PAGE.`{c}`")).alias(c) for c in docs.columns)), "redacted")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", deduplication),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: Tokenisers, sketches and classifiers are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage is written and read again, and then removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if number:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
