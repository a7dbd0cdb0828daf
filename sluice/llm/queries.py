"""The registered queries of this package: each applies its operator to its whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import codes, contamination, langid, neardup, packing, secrets, setjoin, spelling, suffixes, token_files, topk, toxicity, urls
from sluice.llm import texts as X
from sluice.llm.sql import SQL  # noqa: F401
from sluice.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as coded token files, and what is read back from them."""
    files = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(_table(spark, folder, "documents"), files)
    back = token_files.read_tokens(spark, files)
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the passages of 100 bytes or more that have come before."""
    found = suffixes.deduplicated(_table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, from context trees of the rows that are not held out."""
    docs = _table(spark, folder, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select(F.col("key").alias("doc_id"), X.held_out(F.col("key")).alias("held_out"), "lang_pred", "score")


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 4,096 ids."""
    return packing.packed(_table(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = contamination.scan(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return contamination.digest(found)


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(secrets.scan(_table(spark, folder, "documents")))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, learnt from the rows that are not held out."""
    docs = _table(spark, folder, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, folder, "labels")))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return found.select(F.col("key").alias("doc_id"), X.held_out(F.col("key")).alias("held_out"), "score", predicted.alias("predicted"))


def op8_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's url."""
    return urls.judge(_table(spark, folder, "pages")).select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict")


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return neardup.near_duplicates(_table(spark, folder, "documents"), k=4).withColumnRenamed("key", "doc_id")


def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every document under links of similar shingle sets."""
    return setjoin.jaccard_join(_table(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The words of all documents with the more frequent words they are variants of."""
    return spelling.variants(_table(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors as eight-byte codes, with their errors and those of their label."""
    coded = codes.encode(_table(spark, folder, "embeddings"))
    rows = codes.with_label_errors(coded.rows)
    return rows.select(F.col("key").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_url_filter": op9_url_filter,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_vector_codes": op13_vector_codes,
}
