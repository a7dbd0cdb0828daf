"""How close synthetic rows are to real ones: distributions, dependence, usefulness, and closeness to single real rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.ranks import running_sum
from sluice.operators import evaluation, models, preparation, relations
from sluice.session import materialize, small_frame

# --- distributions -------------------------------------------------------------------


def _both(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """``column``, ``v`` and how often it occurs in each table; counted before anything is shuffled."""
    long = lambda df, r, s: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(value).alias("v")) for c in columns])), F.lit(r).alias("r"), F.lit(s).alias("s"))
    rows = long(real, 1, 0).unionByName(long(synthetic, 0, 1)).where(F.col("v").isNotNull())
    return rows.groupBy("column", "v").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))


def kolmogorov_smirnov(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Per numeric column ``n_real``, ``n_synthetic``, ``statistic`` (largest gap of the distribution functions) and ``p_value`` (asymptotic).

    Values are counted per table, all columns together, and sorted by range; running
    sums pass from partition to partition, so no column is sorted by one task.
    """
    counts = materialize(_both(real, synthetic, columns, "double"))
    totals = counts.groupBy("column").agg(F.sum("r").alias("n"), F.sum("s").alias("m"))
    # the gap after a value is what the weighted counts add up to; sums start anew for each column since each column's weights add up to zero
    weighted = counts.join(F.broadcast(totals), "column").where("n > 0 AND m > 0")  # one row per column
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scaled = weighted.withColumn("w", (exact("r") * exact("m") - exact("s") * exact("n")).cast("decimal(38,0)"))
    gaps = running_sum(scaled.select("column", "v", "w", "n", "m"), ["column", "v"], "w", "up")
    found = gaps.groupBy("column", "n", "m").agg(F.max(F.abs(F.col("up").cast("double")) / F.col("n") / F.col("m")).alias("d"))
    effective = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    x = (effective + 0.12 + 0.11 / effective) * F.col("d")
    series = reduce(Column.__add__, [F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, 21)])
    chance = F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return found.select("column", F.col("n").alias("n_real"), F.col("m").alias("n_synthetic"), F.round("d", digits).alias("statistic"), F.round(chance, digits).alias("p_value"))


def chi_square(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Per categorical column the chi-square of its values against the table they are in, degrees of freedom and Cramer's V."""
    counts = _both(real, synthetic, columns, "string")
    per_column = Window.partitionBy("column")  # one row per value
    sized = counts.withColumns({"n": F.sum("r").over(per_column), "m": F.sum("s").over(per_column)}).where("n > 0 AND m > 0")
    all_, size = F.col("r") + F.col("s"), F.col("n") + F.col("m")
    part = lambda seen, rows: (seen - all_ * rows / size) * (seen - all_ * rows / size) / (all_ * rows / size)
    summed = sized.groupBy("column", "n", "m").agg(F.sum(part(F.col("r"), F.col("n")) + part(F.col("s"), F.col("m"))).alias("x"), (F.count(F.lit(1)) - 1).cast("int").alias("dof"))
    return summed.select("column", F.col("n").alias("n_real"), F.col("m").alias("n_synthetic"), F.round("x", digits).alias("statistic"), "dof", F.round(F.sqrt(F.col("x") / size), digits).alias("cramers_v"))


def correlation_gap(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson's coefficient of every pair of columns in either table, their difference, and the mean and largest difference of all pairs."""
    of = lambda df, name: relations.correlations(df, columns, 12).select("left", "right", F.col("r").alias(name))
    met = of(real, "real").join(of(synthetic, "synthetic"), ["left", "right"]).withColumn("gap", F.abs(F.col("real") - F.col("synthetic")))
    whole = Window.partitionBy(F.lit(0))  # one row per pair of columns
    return met.select(
        "left", "right", *[F.round(c, digits).alias(c) for c in ("real", "synthetic", "gap")],
        F.round(F.avg("gap").over(whole), digits).alias("mean_gap"), F.round(F.max("gap").over(whole), digits).alias("largest_gap"),
    )


# --- usefulness ----------------------------------------------------------------------


def usefulness(
    real: DataFrame, synthetic: DataFrame, target: str, key: str, model: str = "logistic_regression", preset: str = "default",
    task: str = "classification", test_share: float = 0.2,
) -> DataFrame:
    """One row per training table: a model trained on real and one on synthetic rows, both judged on the same held-out real rows.

    Features are fitted on the rows a model is trained on and applied to the test
    rows, so nothing of the test rows is known before. ``gap`` is what training on
    synthetic rows costs. A model that cannot be trained is reported, not raised.
    """
    classify = task == "classification"
    known = real.where(F.col(target).isNotNull())
    split = evaluation.holdout(known, key, test_share, target if classify else None).persist()
    try:
        tested, trained = split.where("is_test").drop("is_test"), split.where("NOT is_test").drop("is_test")
        columns = preparation.feature_columns(known, target, [key])
        measure = "accuracy" if classify else "r2"
        rows = []
        for kind, train in (("real", trained), ("synthetic", synthetic.where(F.col(target).isNotNull()))):
            train = train.persist()
            try:
                fitted = models.fit(train, target, columns, key, model=model, preset=preset, task=task, most_frequent=True)
                scores = models.judged(fitted.predict(tested), target, task).first().asDict()
                rows.append((kind, "complete", train.count(), tested.count(), scores[measure], None))
            except Exception as error:  # the other table's result stands
                rows.append((kind, "failed", train.count(), tested.count(), None, str(error)[:500]))
            finally:
                train.unpersist()
    finally:
        split.unpersist()
    base, other = rows[0][4], rows[1][4]
    gap = None if base is None or other is None else round(base - other, 4)
    return small_frame(real.sparkSession, [(*r, gap) for r in rows], "trained_on string, status string, train_rows bigint, test_rows bigint, score double, error_message string, gap double")


# --- privacy -------------------------------------------------------------------------

# hash tables; hyperplanes of each; cells that a vector looks into. More planes make smaller cells, at the cost of
# recall: of vectors without any structure these find the nearest row 19 times in 20
TABLES, PLANES, NEAR_CELLS = 16, 7, 8
ROWS_PER_BLOCK = 2048
SEED = 20240501


def _planes(dim: int, tables: int, planes: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(tables, planes, dim))


def _cells(df: DataFrame, key: str, vector: str, side: str, center: np.ndarray, tables: int, planes: int, near: int) -> DataFrame:
    """``t``, ``cell``, ``id``, ``v``: every vector in its cell of each table, and with ``near`` > 1 in those across its closest hyperplanes."""
    key_type = df.schema[key].dataType
    shape = T.StructType([T.StructField("t", T.IntegerType()), T.StructField("cell", T.LongType()), T.StructField("id", key_type), T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = _planes(len(center), tables, planes)
        bits = np.int64(1) << np.arange(planes, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_PER_BLOCK):
                part = batch.slice(low, ROWS_PER_BLOCK)
                v = np.array(part.column("v").to_pylist(), np.float64).reshape(part.num_rows, -1)
                packed = pa.array([x.tobytes() for x in v], pa.binary())
                for t in range(tables):
                    away = (v - center) @ normals[t].T
                    cell = (away > 0) @ bits
                    order = np.argsort(np.abs(away), axis=1)
                    for probe in range(near):
                        own = cell if probe == 0 else cell ^ bits[order[:, probe - 1]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(own), part.column("id"), packed], schema=pa.schema([("t", pa.int32()), ("cell", pa.int64()), ("id", part.column("id").type), ("v", pa.binary())]))

    return df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, shape).withColumn("side", F.lit(side))


def nearest_real(real: DataFrame, synthetic: DataFrame, key: str, vector: str, tables: int = TABLES, planes: int = PLANES, near: int = NEAR_CELLS) -> DataFrame:
    """Per synthetic row the nearest real row found, its distance, the distance of the second, and their ratio.

    Random hyperplanes through the real rows' mean cut space into cells, anew for
    each table. A synthetic row is compared with the real rows of its own cell and
    of the cells beyond its closest hyperplanes. Cells that hold many rows are
    split into blocks of either side, and a block passes on two rows per synthetic
    row, never pairs. A row that shares no cell with a real one has no neighbour.
    ``synthetic`` and ``real`` hold vectors of one length.
    """
    spark = real.sparkSession
    dim = real.agg(F.max(F.size(vector)).alias("n")).first()["n"]
    mean = real.agg(F.array(*[F.avg(F.get(vector, F.lit(i))) for i in range(dim)]).alias("m")).first()["m"]  # one row
    center = np.array(mean, np.float64)
    held = _cells(real, key, vector, "real", center, tables, planes, 1)
    asked = _cells(synthetic, key, vector, "synthetic", center, tables, planes, near)
    rows = materialize(held.unionByName(asked))
    sizes = rows.groupBy("t", "cell").agg(F.count_if(F.col("side") == "real").alias("r"), F.count_if(F.col("side") == "synthetic").alias("s")).where("r > 0 AND s > 0")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(ROWS_PER_BLOCK)).cast("int")
    met = rows.join(sizes.select("t", "cell", blocks("r").alias("rb"), blocks("s").alias("sb")), ["t", "cell"])
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c).cast("bigint")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    fields = ["t", "cell", "id", "v", "side"]
    spread = met.where("side = 'real'").select(*fields, own("rb").alias("x"), every("sb").alias("y")).unionByName(met.where("side = 'synthetic'").select(*fields, every("rb").alias("x"), own("sb").alias("y")))
    key_type = real.schema[key].dataType
    found = T.StructType([T.StructField("id", synthetic.schema[key].dataType), T.StructField("real_id", key_type), T.StructField("distance", T.DoubleType())])

    def closest(table: pa.Table) -> pa.Table:
        side = np.array(table.column("side").to_pylist())
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(len(side), -1)
        ids = table.column("id").combine_chunks()
        reals, asks = np.flatnonzero(side == "real"), np.flatnonzero(side == "synthetic")
        gaps = np.maximum((v[asks] ** 2).sum(axis=1)[:, None] + (v[reals] ** 2).sum(axis=1)[None] - 2 * v[asks] @ v[reals].T, 0)
        take = np.argsort(gaps, axis=1, kind="stable")[:, :2]
        i, j = np.repeat(asks, take.shape[1]), reals[take].ravel()
        exact = np.sqrt(((v[i] - v[j]) ** 2).sum(axis=1))
        return pa.table([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(exact)], names=["id", "real_id", "distance"])

    near_ones = spread.groupBy("t", "cell", "x", "y").applyInArrow(closest, found).groupBy("id", "real_id").agg(F.min("distance").alias("distance"))
    place = Window.partitionBy("id").orderBy("distance", "real_id")  # two rows per block and cell, cut before the shuffle
    two = near_ones.withColumn("place", F.row_number().over(place)).where("place <= 2")
    nth = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    per_row = two.groupBy("id").agg(nth(1, "real_id").alias("real_id"), nth(1, "distance").alias("distance"), nth(2, "distance").alias("second"))
    ratio = F.when(F.col("second") > 0, F.col("distance") / F.col("second")).when(F.col("second") == 0, 1.0)
    keys = synthetic.select(F.col(key).alias("id"))
    return keys.join(per_row, "id", "left").select(F.col("id").alias(key), "real_id", "distance", "second", ratio.alias("ratio"))


def privacy_summary(near: DataFrame, close: float = 0.33, digits: int = 6) -> DataFrame:
    """One row: synthetic rows, those with a neighbour, exact copies, rows much closer to one real row than to any other, mean distance and ratio."""
    return near.agg(
        F.count(F.lit(1)).alias("rows"), F.count("distance").alias("matched"), F.count_if(F.col("distance") == 0).alias("copies"),
        F.count_if(F.col("ratio") < close).alias("exposed"), F.round(F.avg("distance"), digits).alias("mean_distance"), F.round(F.avg("ratio"), digits).alias("mean_ratio"),
    )

