"""Synthetic rows: resampling, a Gaussian copula, and per-column overrides."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.draws import uniform, wide_draw
from sluice.functions.quantiles import quantiles
from sluice.functions.ranks import rank_by_draw, take_ranks
from sluice.functions.types import INTEGERS, is_numeric
from sluice.session import small_frame

SEED = 42
GRID = 201  # points of a marginal's quantile function
MAX_CATEGORIES = 1_000
ALL_PARTITIONS = 1 << 20  # more than any range of rows has
DISTRIBUTIONS = ("normal", "log_normal", "uniform", "beta")
NORMAL = NormalDist()

MODEL = """column string, ordinal int, data_type string, kind string, null_rate double, grid array<double>,
    categories array<struct<value: string, upto: double>>, loadings array<double>"""


# --- resampling -----------------------------------------------------------------


def bootstrap(df: DataFrame, n: int, key: str, seed: int | str = SEED, row_id: str | None = None) -> DataFrame:
    """``n`` rows drawn with replacement: draw i takes the row of rank ``wide_draw(i) mod size``."""
    size = df.count()
    if size == 0:
        return df
    ranked = rank_by_draw(df, [], key, seed, "__rank")
    picks = df.sparkSession.range(n).select(F.col("id").alias("__pick"), (F.pmod(wide_draw(F.col("id"), seed), F.lit(size)) + 1).alias("__rank"))
    kept = [F.col("__pick").alias(row_id)] if row_id else []
    return take_ranks(picks, ranked, size, n).select(*kept, *df.columns)


# --- overrides --------------------------------------------------------------------


def clip(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    value = F.col(column)
    if low is not None:
        value = F.when(value < low, F.lit(float(low))).otherwise(value)
    if high is not None:
        value = F.when(value > high, F.lit(float(high))).otherwise(value)
    kind = df.schema[column].dataType
    whole = isinstance(kind, INTEGERS) and all(b is None or float(b).is_integer() for b in (low, high))
    return df.withColumn(column, value.cast(kind) if whole else value)


def reweigh(df: DataFrame, column: str, weights: dict[str, float], key: str, seed: int | str = SEED) -> DataFrame:
    """Redraw a category for every row by the given weights, independently per row."""
    total = sum(float(v) for v in weights.values())
    if not weights or total <= 0:
        return df
    u, upto, choice = uniform(key, f"{seed}|{column}|class"), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        upto += float(weights[name]) / total
        choice = F.when(u < upto, F.lit(str(name))) if choice is None else choice.when(u < upto, F.lit(str(name)))
    choice = F.lit(str(names[-1])) if choice is None else choice.otherwise(F.lit(str(names[-1])))
    kind = df.schema[column].dataType
    fits = not is_numeric(kind) or all(_is_number(n) for n in names)
    return df.withColumn(column, choice.cast(kind) if fits else choice)


def _is_number(text: object) -> bool:
    try:
        float(text)
        return True
    except (TypeError, ValueError):
        return False


def blank(df: DataFrame, column: str, rate: float, key: str, seed: int | str = SEED) -> DataFrame:
    """Set a share of the values to null, decided per row by its draw."""
    if rate <= 0:
        return df
    return df.withColumn(column, F.when(uniform(key, f"{seed}|{column}|null") >= rate, F.col(column)))


def apply_overrides(df: DataFrame, overrides: dict[str, dict], key: str, seed: int | str = SEED) -> DataFrame:
    """Per column: lower bound, upper bound, class weights, null rate, in this order."""
    for column, options in (overrides or {}).items():
        if column not in df.columns:
            continue
        if is_numeric(df.schema[column].dataType):
            df = clip(df, column, options.get("min"), options.get("max"))
        if options.get("class_weights"):
            df = reweigh(df, column, options["class_weights"], key, seed)
        if float(options.get("null_rate", 0)) > 0:
            df = blank(df, column, float(options["null_rate"]), key, seed)
    return df


# --- Gaussian copula -----------------------------------------------------------------


def _grid_for(family: str, low: float, high: float, mean: float, std: float) -> list[float]:
    """Quantiles of a named distribution with the column's moments, as a grid."""
    probs = (np.arange(GRID) + 0.5) / GRID
    if family == "uniform":
        return (low + (high - low) * probs).tolist()
    if std <= 0:
        return [mean] * GRID
    if family == "normal":
        return [mean + std * NORMAL.inv_cdf(p) for p in probs]
    if family == "log_normal":  # gamma, shifted to start at the smallest value
        centre = max(mean - low, 1e-9)
        shape, scale = (centre / std) ** 2, std**2 / centre
        x = np.linspace(1e-9, max(centre + 12 * std, 1e-6), 20_001)
        density = (shape - 1) * np.log(x) - x / scale
        return (low + _quantiles_of(x, density, probs)).tolist()
    spread = max(high - low, 1e-12)  # beta on [low, high]
    m, v = (mean - low) / spread, (std / spread) ** 2
    common = max(m * (1 - m) / v - 1, 1e-3)
    a, b = max(m * common, 1e-3), max((1 - m) * common, 1e-3)
    x = np.linspace(1e-6, 1 - 1e-6, 20_001)
    density = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    return (low + spread * _quantiles_of(x, density, probs)).tolist()


def _quantiles_of(x: np.ndarray, log_density: np.ndarray, probs: np.ndarray) -> np.ndarray:
    weight = np.cumsum(np.exp(log_density - log_density.max()))
    return np.interp(probs, weight / weight[-1], x)


def _text_categories(df: DataFrame, names: Sequence[str]) -> dict[str, list[tuple[str, float]] | None]:
    """Values with their cumulative shares; None for columns with too many values to list."""
    if not names:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in names])
    counts = df.select(F.inline(pairs)).where("v IS NOT NULL").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["column"]: r["k"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    small = [c for c in names if 0 < sizes.get(c, 0) <= MAX_CATEGORIES]
    listed: dict[str, list] = {c: [] for c in small}
    if small:
        for r in counts.where(F.col("column").isin(small)).collect():  # at most MAX_CATEGORIES per column
            listed[r["column"]].append((r["v"], r["n"]))
    found: dict[str, list[tuple[str, float]] | None] = {c: None for c in names}
    for c, rows in listed.items():
        rows.sort(key=lambda r: (-r[1], r[0]))
        total, upto, out = sum(n for _, n in rows), 0, []
        for value, n in rows:
            upto += n
            out.append((value, upto / total))
        found[c] = out
    return found


def fit(df: DataFrame, columns: Sequence[str] | None = None, distributions: dict[str, str] | None = None) -> DataFrame:
    """A model with one row per column: marginal, share of nulls and its row of the copula.

    Marginals come from a quantile sketch (or the moments, where a distribution
    is asked for). The dependence is the correlation of normal scores, taken in
    one pass after binning each value by its column's quantiles.
    """
    columns = list(columns or df.columns)
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    texts = [c for c in columns if c not in numeric]
    moments = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"n:{c}") for c in columns],
        *[f(F.col(c).cast("double")).alias(f"{name}:{c}") for c in numeric
          for name, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("std", F.stddev_pop))],
    ).first()  # one row
    rows = moments["rows"]
    probs = [k / (GRID - 1) for k in range(GRID)]
    grids = {r["column"]: list(r["q"]) for r in quantiles(df, numeric, probs, approximate=True).collect() if r["q"]} if numeric else {}
    categories = _text_categories(df, texts)
    scored, scores = [], []
    binned = df
    cuts = {c: sorted(set(g)) for c, g in grids.items()}
    dense = [c for c in numeric if len(cuts.get(c, ())) >= 2]
    if dense:
        splits = [[-math.inf, *cuts[c][1:-1], math.inf] for c in dense]
        binned = Bucketizer(
            splitsArray=splits, inputCols=dense, outputCols=[f"__b{i}" for i in range(len(dense))], handleInvalid="keep"
        ).transform(binned)
    for i, c in enumerate(dense):
        grid = grids[c]
        middle = []
        for left, right in zip([-math.inf, *cuts[c][1:-1]], [*cuts[c][1:-1], math.inf]):
            inside = [p for p, g in zip(probs, grid) if left <= g < right] or [probs[-1]]
            middle.append(min(max((inside[0] + inside[-1]) / 2, 0.002), 0.998))
        score = F.element_at(F.array(*[F.lit(NORMAL.inv_cdf(p)) for p in middle]), (F.col(f"__b{i}") + 1).cast("int"))
        scored.append(c)
        scores.append(F.when(F.col(c).isNotNull(), score).otherwise(0.0))
    for c, listed in categories.items():
        if not listed or len(listed) < 2:
            continue
        start, pairs = 0.0, []
        for value, upto in listed:
            middle_p = min(max((start + upto) / 2, 0.002), 0.998)
            pairs += [F.lit(value), F.lit(NORMAL.inv_cdf(middle_p))]
            start = upto
        scored.append(c)
        scores.append(F.coalesce(F.create_map(*pairs)[F.col(c).cast("string")], F.lit(0.0)))
    loadings = _loadings(binned, scored, scores)
    out = []
    for i, c in enumerate(columns):
        kind = "numeric" if c in numeric else ("category" if categories[c] else "resampled")
        grid = grids.get(c)
        family = (distributions or {}).get(c)
        if grid and family in DISTRIBUTIONS:
            grid = _grid_for(family, moments[f"lo:{c}"], moments[f"hi:{c}"], moments[f"mean:{c}"], moments[f"std:{c}"])
        share = 1 - moments[f"n:{c}"] / rows if rows else 1.0
        listed = [{"value": v, "upto": u} for v, u in categories[c]] if categories.get(c) else None
        if kind == "numeric" and not grid:
            kind = "empty"
        if kind == "resampled" and moments[f"n:{c}"] == 0:
            kind = "empty"
        out.append((c, i, df.schema[c].dataType.simpleString(), kind, float(share), grid, listed, loadings.get(c)))
    return small_frame(df.sparkSession, out, MODEL)


def _loadings(df: DataFrame, names: list[str], scores: list[Column]) -> dict[str, list[float]]:
    """Rows of the Cholesky factor of the correlation of normal scores; as wide as the schema."""
    if not names:
        return {}
    if len(names) == 1:
        return {names[0]: [1.0]}
    wide = df.select(*[s.alias(f"z{i}") for i, s in enumerate(scores)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    row = wide.agg(*[F.corr(f"z{i}", f"z{j}").alias(f"{i}:{j}") for i, j in pairs]).first()  # one row, one pass
    matrix = np.eye(len(names))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = np.nan_to_num(row[f"{i}:{j}"] if row[f"{i}:{j}"] is not None else 0.0)
    values, basis = np.linalg.eigh((matrix + matrix.T) / 2)
    near = basis @ np.diag(np.clip(values, 1e-6, None)) @ basis.T
    scale = np.sqrt(np.diag(near))
    factor = np.linalg.cholesky(near / np.outer(scale, scale))
    return {c: factor[i].tolist() for i, c in enumerate(names)}


def with_normal_cdf(df: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """Adds the standard normal distribution function of ``scores`` (Abramowitz and Stegun 7.1.26, error below 2e-7).

    Step by step for all: written as one expression, each score would be computed many times over, in a method too long to be compiled.
    """
    z, t, half = (lambda c: F.col(f"z:{c}")), (lambda c: F.col(f"t:{c}")), (lambda c: F.col(f"h:{c}"))
    x = lambda c: F.abs(z(c)) / math.sqrt(2)
    poly = lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    df = df.withColumns({f"z:{c}": score for c, score in scores.items()})
    df = df.withColumns({f"t:{c}": 1 / (1 + 0.3275911 * x(c)) for c in scores})
    df = df.withColumns({f"h:{c}": (1 - poly(t(c)) * F.exp(-x(c) * x(c))) / 2 for c in scores})
    df = df.withColumns({f"u:{c}": F.when(z(c) >= 0, 0.5 + half(c)).otherwise(0.5 - half(c)) for c in scores})
    return df.drop(*[f"{k}:{c}" for c in scores for k in "zth"])


def _apart(rows: DataFrame) -> DataFrame:
    """The same rows in the same partitions. What comes before and after is generated into methods of their own: one for all is too long to be compiled."""
    return rows.coalesce(ALL_PARTITIONS)


def sample(
    model: DataFrame, n: int, seed: int | str = SEED, source: DataFrame | None = None, key: str | None = None,
    row_id: str = "row_id",
) -> DataFrame:
    """``n`` rows from a fitted model; each value depends on the row number and the seed only.

    Columns with too many categories to list are resampled from ``source``.
    """
    spark = model.sparkSession
    parts = model.orderBy("ordinal").collect()  # one row per column
    width = max((len(p["loadings"]) for p in parts if p["loadings"]), default=0)
    rows = spark.range(n).withColumnRenamed("id", row_id)
    first = lambda j: F.greatest(uniform(row_id, f"{seed}|a{j}"), F.lit(1e-12))
    angle = lambda j: uniform(row_id, f"{seed}|b{j}") * (2 * math.pi)
    for j in range(0, width, 4):  # a few at a time, see _apart
        rows = _apart(rows.withColumns({f"e{k}": F.sqrt(-2 * F.log(first(k))) * F.cos(angle(k)) for k in range(j, min(j + 4, width))}))
    weighed = {
        p["column"]: sum((F.lit(w) * F.col(f"e{j}") for j, w in enumerate(p["loadings"]) if w), F.lit(0.0)) for p in parts if p["loadings"]
    }
    rows = _apart(with_normal_cdf(rows, weighed))
    rows = rows.withColumns({f"u:{p['column']}": uniform(row_id, f"{seed}|{p['column']}") for p in parts if not p["loadings"]})
    several = [p for p in parts if p["kind"] == "category" and len(p["categories"]) > 1]
    if several:  # the place of the first category whose cumulative share is above the chance
        splits = [[-math.inf, *[c["upto"] for c in p["categories"][:-1]], math.inf] for p in several]
        names = [p["column"] for p in several]
        rows = Bucketizer(splitsArray=splits, inputCols=[f"u:{c}" for c in names], outputCols=[f"k:{c}" for c in names]).transform(rows)
    resampled = [p["column"] for p in parts if p["kind"] == "resampled"]
    if resampled:
        if source is None or key is None:
            raise ValueError(f"columns {resampled} need the source table and its key")
        wanted = source.select(*dict.fromkeys([key, *resampled])).withColumnRenamed(key, "__key")
        if key in resampled:
            wanted = wanted.withColumn(key, F.col("__key"))
        drawn = bootstrap(wanted, n, "__key", f"{seed}|rows", row_id="__id").drop("__key")
        rows = rows.join(drawn, F.col(row_id) == F.col("__id")).drop("__id")
    picks = [F.col(row_id)]
    for p in parts:
        value = _value(p).cast(p["data_type"])
        if p["null_rate"] > 0 and p["kind"] not in ("resampled", "empty"):
            value = F.when(uniform(row_id, f"{seed}|{p['column']}|missing") >= p["null_rate"], value)
        picks.append(value.alias(p["column"]))
    return rows.select(*picks)


def _value(p) -> Column:
    u = F.col(f"u:{p['column']}")
    if p["kind"] == "numeric":
        grid = F.array(*[F.lit(float(g)) for g in p["grid"]])
        spot = u * (len(p["grid"]) - 1)
        at = F.least(F.floor(spot).cast("int"), F.lit(len(p["grid"]) - 2))
        low, high = F.element_at(grid, at + 1), F.element_at(grid, at + 2)
        value = low + (spot - at) * (high - low)
        whole = p["data_type"] in ("tinyint", "smallint", "int", "bigint")
        return F.round(value) if whole else value
    if p["kind"] == "category":
        names = [c["value"] for c in p["categories"]]
        return F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(f"k:{p['column']}") + 1).cast("int")) if len(names) > 1 else F.lit(names[0])
    if p["kind"] == "resampled":
        return F.col(p["column"])
    return F.lit(None)


def fit_or_load(
    df: DataFrame, root: str, dataset: str, method: str = "statistical", distributions: dict[str, str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The stored model of a dataset, fitted and stored on first use.

    Other columns, distributions or types make another model. Data that changed
    under the same name needs another ``dataset`` name or version.
    """
    asked = json.dumps([[(c, df.schema[c].dataType.simpleString()) for c in columns or df.columns], sorted((distributions or {}).items())])
    path = f"{root}/{dataset}_{method}_{hashlib.sha256(asked.encode()).hexdigest()[:12]}.parquet"
    if not _complete(df.sparkSession, path):
        fit(df, columns, distributions).coalesce(1).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
