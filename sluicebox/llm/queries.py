"""One query for each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.llm.bpe import encode_texts
from sluicebox.llm.common import materialise_texts
from sluicebox.llm.cotraining import classify_quality
from sluicebox.llm.fertility import quality_rules
from sluicebox.llm.main_text import extract_main_text
from sluicebox.llm.near_duplicates import near_duplicates
from sluicebox.llm.packing import pack_documents
from sluicebox.llm.recursive_bpe import encode_by_queries
from sluicebox.llm.secret_scan import KINDS, scan_secrets
from sluicebox.llm.sharding import shard_documents
from sluicebox.llm.token_alignment import align_tokens
from sluicebox.llm.topk import top_products
from sluicebox.llm.toxicity import classify_toxicity, held_out
from sluicebox.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify_quality(documents(spark, sf_dir), labels(spark, sf_dir), ["doc_id"], ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "content_margin", "meta_margin", "score", "kept")


def op2_dictionary_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(documents(spark, sf_dir), 8)
    columns = ["doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"]
    return sharded.select(*columns)


def op4_boosted_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    text = F.col("main_text")
    return pages.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def _listed(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


def op5_token_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(documents(spark, sf_dir), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op7_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op8_odd_sketch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(documents(spark, sf_dir), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), ["doc_id"])


def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id"])
    exact = F.col("deviation")
    return whitened.withColumn("deviation", exact.try_cast("bigint")).withColumn("deviation_exact", exact)


def op12_hashed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokens(documents(spark, sf_dir))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return materialise_texts(aligned.withColumn("groups", digest), "aligned").withColumnRenamed("groups", "groups_sha256")


def op13_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_by_queries(documents(spark, sf_dir), decoded="decoded")
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return materialise_texts(coded.select("doc_id", "n_tokens", *digests), "coded")


QUERIES: dict[str, Query] = {
    "op1_cotrained_quality": op1_cotrained_quality,
    "op2_dictionary_toxicity": op2_dictionary_toxicity,
    "op3_jump_shards": op3_jump_shards,
    "op4_boosted_extraction": op4_boosted_extraction,
    "op5_token_secrets": op5_token_secrets,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_impact_ordered_topk": op7_impact_ordered_topk,
    "op8_odd_sketch_duplicates": op8_odd_sketch_duplicates,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_tokeniser_fertility": op10_tokeniser_fertility,
    "op11_bit_sliced_whitening": op11_bit_sliced_whitening,
    "op12_hashed_alignment": op12_hashed_alignment,
    "op13_recursive_bpe": op13_recursive_bpe,
}
ORACLE: dict[str, str] = {
    "op7_impact_ordered_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
