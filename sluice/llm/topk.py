"""Exact top-k by inner product with norm-bucketed retrieval.

Components become integers, floor(256 * x). Vectors are put into buckets of
nearly equal length, and a bucket is cut into blocks of at most ``BLOCK``
vectors, so that many equal vectors do not meet in one task. Queries are dealt
into blocks too. The answer is found in two passes over pairs of blocks:

* The first gives every query a threshold: its k-th best score among the
  longest vectors, ``FIRST`` blocks of them.
* In the second a query block meets a bucket's blocks only if some query of it
  needs no cosine above 1 there: threshold / (its length * the bucket's longest).
  Inside a block each query prunes by its local cosine threshold: where it is
  high, by coordinates (what its ``FOCUS`` largest coordinates give and the
  Cauchy bound on the rest); else by length. What is left is verified by the
  integer product.

Blocks are pruned before they are shipped, and a block pair returns k rows a
query. Ties go to the smaller id.

Vectors that are null or hold null or non-finite components take no part, nor do
rows without an id. Only vectors with the same number of components are
compared. Rows that repeat an id with the same vector count once; different
vectors under one id are different candidates, the smallest of them (fewer
components, then smaller ones) asks, and a query never finds its own id. An empty
table gives no rows. Other columns are not read, whatever their names. A query with fewer than k candidates gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import texts as X

BLOCK = 4096  # candidates of a block
QUERIES = 1024  # queries of a block
FIRST = 2
FOCUS = 8
SAFE = float(2**53)  # products below are exact as doubles

_PACKED = "dim int, bucket int, block int, ids binary, vectors binary, longest double"


def quantized(df: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """``key``, ``v`` (integer components as longs) and ``norm`` (squared length) of the vectors that take part."""
    v = F.col(vector)
    sound = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("bigint"))
    out = df.where(sound).select(F.col(key).cast("bigint").alias("key"), whole.alias("v")).distinct()
    return out.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _level(norm: Column) -> Column:
    """Buckets of lengths that differ by at most an eighth of an octave; longer ones have smaller numbers."""
    return F.when(norm > 0, -F.floor(F.log2(norm) * 4)).otherwise(F.lit(1 << 20)).cast("int")


def _pack(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors of a bucket in blocks of about ``size``, each one row of packed integers."""
    counted = vectors.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("bigint").alias("blocks"))
    dealt = vectors.join(counted, ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        flat = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)[order]
        return pa.table(
            [
                pa.array([table.column("dim")[0].as_py()], pa.int32()),
                pa.array([table.column("bucket")[0].as_py()], pa.int32()),
                pa.array([table.column("block")[0].as_py()], pa.int32()),
                pa.array([keys[order].tobytes()], pa.binary()),
                pa.array([np.ascontiguousarray(flat, np.int64).tobytes()], pa.binary()),
                pa.array([float(np.sqrt((flat.astype(float) ** 2).sum(axis=1)).max())]),
            ],
            names=["dim", "bucket", "block", "ids", "vectors", "longest"],
        )

    return dealt.groupBy("dim", "bucket", "block").applyInArrow(pack, X.schema(_PACKED))


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; as doubles where these are exact."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < SAFE:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    return q @ v.T


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every query its ``k`` best of a block among those that reach its ``floor``: query, id, score."""
    out_q, out_id, out_s = [], [], []
    own = v.astype(float)
    length = np.sqrt((own**2).sum(axis=1))
    order = np.argsort(-length, kind="stable")  # by length, the longest first
    ids, v, own, length = ids[order], v[order], own[order], length[order]
    for i in range(len(q_ids)):
        mine = q[i].astype(float)
        size = float(np.sqrt((mine**2).sum()))
        need = floor[i]
        if np.isfinite(need) and need > 0 and size > 0 and length[0] > 0:
            reach = int(np.searchsorted(-length, -need / size * (1 - 1e-9), "right"))  # shorter ones cannot reach it
            local = need / (size * length[0])
            left = np.arange(reach)
            if reach and local > 0.3 and len(mine) > 2 * FOCUS:  # coordinates prune
                focus = np.argpartition(-np.abs(mine), FOCUS)[:FOCUS]
                part = own[:reach][:, focus]
                rest_q = np.sqrt(max(size**2 - (mine[focus] ** 2).sum(), 0.0))
                rest_v = np.sqrt(np.maximum(length[:reach] ** 2 - (part**2).sum(axis=1), 0.0))
                left = np.flatnonzero(part @ mine[focus] + rest_q * rest_v >= need * (1 - 1e-9) - 1e-6)
        else:
            left = np.arange(len(ids))
        left = left[ids[left] != q_ids[i]]
        if not len(left):
            continue
        score = _product(q[i : i + 1], v[left])[0]
        keep = np.flatnonzero(score >= need) if np.isfinite(need) else np.arange(len(left))
        if len(keep) > k:
            least = np.partition(score[keep], len(keep) - k)[len(keep) - k]
            keep = keep[score[keep] >= least]
            keep = keep[np.lexsort((ids[left[keep]], -score[keep]))[:k]]
        out_q.append(np.full(len(keep), q_ids[i]))
        out_id.append(ids[left[keep]])
        out_s.append(score[keep])
    if not out_q:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def _meet(pairs: DataFrame, k: int) -> DataFrame:
    """Rows of a query block and a candidate block as the queries' best of that block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["q_vectors"], np.int64).reshape(len(q_ids), -1)
                v = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1)
                found = _best(q_ids, q, ids, v, np.frombuffer(row["floors"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, X.schema("query_id bigint, vec_id bigint, score bigint"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """The ``k`` highest scores of every row for which ``queries`` holds, against all other rows: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    vectors = quantized(df, key, vector).select("key", "v", "norm", F.size("v").alias("dim"))
    leveled = vectors.withColumn("bucket", _level(F.col("norm")))
    blocks = X.written(_pack(leveled.select("key", "v", "dim", "bucket"), BLOCK, "candidates"))
    asked = quantized(df.where(queries), key, vector).select("key", "v", F.size("v").alias("dim"), _level(F.col("norm")).alias("bucket"))
    asked = asked.groupBy("key").agg(F.min(F.struct("dim", "v", "bucket")).alias("own")).select("key", F.col("own")["v"].alias("v"), F.col("own")["dim"].alias("dim"), F.col("own")["bucket"].alias("bucket"))
    query_blocks = X.written(_pack(asked, QUERIES, "queries").select("dim", F.struct("dim", "bucket", "block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    place = Window.partitionBy("dim").orderBy("bucket", "block")  # one row per block
    order = blocks.select("dim", "bucket", "block", "longest").withColumn("at", F.row_number().over(place))
    plain = query_blocks.withColumn("floors", _floors()(F.col("q_ids")))
    first = _ship(plain, order.where(F.col("at") <= FIRST), blocks)
    seen = X.written(_ranked(_meet(first, k), k))
    floors = seen.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    bounded = _with_floors(query_blocks, floors)
    rest = _ship(bounded, order.where(F.col("at") > FIRST), blocks)
    found = _meet(rest, k).unionByName(seen.select("query_id", "vec_id", "score"))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _floors():
    @F.pandas_udf("binary")
    def none(ids):
        return ids.map(lambda b: np.full(len(b) // 8, -np.inf).tobytes())

    return none


def _with_floors(query_blocks: DataFrame, floors: DataFrame) -> DataFrame:
    """Query blocks with the threshold of each query."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("q_ids")[i].as_py(), np.int64)
                struct = pa.array([batch.column("q_block")[i].as_py()] * len(ids), batch.column("q_block").type)
                yield pa.RecordBatch.from_arrays([struct, pa.array(np.arange(len(ids))), pa.array(ids)], names=["q_block", "n", "id"])

    each = query_blocks.mapInArrow(spread, X.schema("q_block struct<dim:int,bucket:int,block:int>, n bigint, id bigint"))
    lists = each.join(floors, "id", "left").groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("f")))).alias("l"))

    @F.pandas_udf("binary")
    def packed(values):
        return values.map(lambda x: np.array([y["f"] for y in x], float).tobytes())

    return query_blocks.join(lists.select("q_block", packed(F.col("l")).alias("floors")), "q_block")  # blocks of every dimension are numbered anew


def _ship(query_blocks: DataFrame, order: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of query blocks and candidate blocks in which some query can still find something.

    A query block asks for one number, the shortest vector that any of its queries
    needs. Numbers meet first; vectors are shipped for the pairs that are left.
    """

    @F.pandas_udf("double")
    def shortest(q_ids, q_vectors, floors):
        import pandas as pd

        out = []
        for ids, vectors, floor in zip(q_ids, q_vectors, floors):
            q = np.frombuffer(vectors, np.int64).reshape(len(ids) // 8, -1).astype(float)
            size = np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)
            least = np.frombuffer(floor) - 1e-6
            needs = np.where(size > 0, least / np.where(size > 0, size, 1), np.where(least <= 0, -np.inf, np.inf))
            out.append(float(needs.min()))
        return pd.Series(out)

    asks = query_blocks.select("dim", "q_block", shortest("q_ids", "q_vectors", "floors").alias("need"))
    # numbers of blocks only: a stated set of query blocks against all blocks
    met = asks.join(order.select("dim", "bucket", "block", "longest"), "dim").where(F.col("longest") >= F.col("need")).select("dim", "q_block", "bucket", "block")
    return met.join(query_blocks, ["dim", "q_block"]).join(blocks.drop("longest"), ["dim", "bucket", "block"])
