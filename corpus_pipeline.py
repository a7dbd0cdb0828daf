"""From raw documents to packed training sequences; every stage is one of the operators of ``sluice.llm``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import contamination, neardup, packing, secrets, toxicity
from sluice.llm import texts as X
from sluice.session import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the keys of ``rejected(key)``; rows without a key stay."""
    keys = rejected.select(F.col("key").alias("__key")).distinct()
    return docs.join(keys, F.col("doc_id").cast("long") == F.col("__key"), "left_anti")


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The classifier learns from the documents at hand that are not held out."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = X.written(toxicity.score(docs, model))
    return _without(docs, scored.where((F.col("score") >= toxicity.THRESHOLD) & F.col("key").isNotNull()))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays."""
    found = neardup.near_duplicates(docs)
    return _without(docs, found.where(~F.col("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go; the others stay as they are."""
    found = contamination.scan(docs, _table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where(contamination.contaminated(F.col("n_hit"), F.col("n_words"))))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark, and ``n_chars`` follows; documents without secrets stay as they are."""
    found = secrets.scan(docs.withColumn("__row", F.struct(*docs.columns)), carry="__row")
    some = F.size("spans") > 0
    cut = found.select("__row", some.alias("__some"), F.when(some, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("__row.text")).alias("__text"))
    size = F.when(F.col("__some"), F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    own = {"text": F.col("__text"), "n_chars": size}
    return cut.select(*[own.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, packed into sequences of 4,096 ids."""
    return packing.packed(docs).withColumnRenamed("key", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", detoxify),
    ("near duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("secret scan", redact),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # neither the classifier nor the tokenizer can be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
