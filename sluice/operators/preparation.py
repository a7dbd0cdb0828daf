"""Turn columns into model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.draws import uniform
from sluice.functions.quantiles import quantiles
from sluice.functions.scalars import mode_of
from sluice.functions.types import is_numeric
from sluice.operators.steps import encode_columns

MISSING = "missing"
MAX_CLASSES = 30
MAX_INDICATORS = 1_000  # text columns with more values are hashed, not listed
HASHED_FEATURES = 4_096


def feature_columns(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c != target and c not in set(exclude)]


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    found = {c: None for c in columns}
    if columns:
        for r in quantiles(df, columns, [0.5]).collect():  # one row per column
            found[r["column"]] = r["q"][0] if r["q"] else None
    return found


def _moments(df: DataFrame, filled: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the filled columns, in one pass."""
    names = list(filled)
    row = df.agg(
        *[F.avg(filled[c]).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_pop(filled[c]).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(names) if row[f"m{i}"] is not None}


def numeric_expressions(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> dict[str, Column]:
    """Median fill and standard scores, fitted on ``df``; constant columns are only centred."""
    if not columns:
        return {}
    middle = medians(df, columns)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c])) for c in columns}
    moments = _moments(df, filled)
    scaled = {}
    for c in columns:
        mean, std = moments.get(c, (0.0, 0.0))
        scaled[c] = F.coalesce((filled[c] - F.lit(mean)) / F.lit(std if std else 1.0), F.lit(0.0))
    return scaled


def numeric_prep(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(numeric_expressions(df, columns))


def fill_categories(df: DataFrame, columns: Sequence[str], most_frequent: bool = False) -> DataFrame:
    """Missing categories become a category of their own, or the most frequent one."""
    text = lambda c: F.col(c).cast("string")
    if not most_frequent:
        return df.withColumns({c: F.coalesce(text(c), F.lit(MISSING)) for c in columns})
    return df.withColumns({c: F.coalesce(text(c), mode_of(df, c).cast("string")) for c in columns})


def categories(df: DataFrame, column: str, limit: int) -> list[str] | None:
    """Sorted distinct values, or None if there are more than ``limit``."""
    some = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct()
    found = [r["v"] for r in some.limit(limit + 1).collect()]
    return sorted(found) if len(found) <= limit else None


def one_hot(df: DataFrame, columns: Sequence[str], most_frequent: bool = False, train: DataFrame | None = None) -> DataFrame:
    """Indicator columns ``column_value``; values unknown to ``train`` are zero everywhere."""
    filled = fill_categories(df, columns, most_frequent)
    base = filled if train is None else fill_categories(train, columns, most_frequent)
    added = {}
    for c in columns:
        listed = categories(base, c, MAX_INDICATORS)
        if listed is None:
            raise ValueError(f"{c} has more than {MAX_INDICATORS} values; use feature_stages")
        for v in listed:
            added[f"{c}_{v}"] = (F.col(c) == F.lit(v)).cast("int")
    return filled.withColumns(added)


def classes(df: DataFrame, target: str, limit: int = MAX_CLASSES) -> DataFrame:
    """The sorted class names as text, or nothing if there are too many."""
    some = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("label")).distinct().limit(limit + 1)
    number = some.agg(F.count(F.lit(1)).alias("n")).scalar()
    return some.where(number <= limit).orderBy("label")


def label_encode(df: DataFrame, target: str, into: str = "label_code") -> DataFrame:
    return encode_columns(df.withColumn(into, F.col(target).cast("string")), [into])


class Features:
    """Fitted preparation: expressions and indexers that make a ``features`` vector."""

    def __init__(self, train: DataFrame, columns: Sequence[str], most_frequent: bool = False):
        self.numeric = [c for c in columns if is_numeric(train.schema[c].dataType)]
        self.texts = [c for c in columns if c not in self.numeric]
        sizes = train.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.approx_count_distinct(F.col(c).cast("string")).alias(f"k:{c}") for c in self.texts],
        ).first()
        self.rows = sizes["rows"]
        self.scaled = numeric_expressions(train, self.numeric, self.rows)
        self.modes = {c: (mode_of(train, c).cast("string") if most_frequent else F.lit(MISSING)) for c in self.texts}
        wide = self._expressed(train)
        self.listed = [c for c in self.texts if sizes[f"k:{c}"] <= MAX_INDICATORS]
        self.hashed = [c for c in self.texts if c not in self.listed]
        stages = []
        if self.listed:
            stages.append(
                StringIndexer(
                    inputCols=[f"t:{c}" for c in self.listed], outputCols=[f"i:{c}" for c in self.listed],
                    handleInvalid="keep", stringOrderType="alphabetAsc",
                )
            )
            # the index kept for unknown values is the one that dropLast leaves out
            stages.append(
                OneHotEncoder(
                    inputCols=[f"i:{c}" for c in self.listed], outputCols=[f"o:{c}" for c in self.listed], dropLast=True
                )
            )
        if self.hashed:
            stages.append(
                FeatureHasher(inputCols=[f"t:{c}" for c in self.hashed], outputCol="hashed", numFeatures=HASHED_FEATURES)
            )
        parts = [f"x:{c}" for c in self.numeric] + [f"o:{c}" for c in self.listed] + (["hashed"] if self.hashed else [])
        stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
        self.model: PipelineModel = Pipeline(stages=stages).fit(wide)

    def _expressed(self, df: DataFrame) -> DataFrame:
        texts = {f"t:{c}": F.coalesce(F.col(c).cast("string"), self.modes[c]) for c in self.texts}
        return df.withColumns({f"x:{c}": e for c, e in self.scaled.items()} | texts)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._expressed(df)).select(*df.columns, "features")

    @property
    def names(self) -> list[str]:
        """Feature names in vector order."""
        out = list(self.numeric)
        labels = self.model.stages[0].labelsArray if self.listed else []
        for c, values in zip(self.listed, labels):
            out += [f"{c}_{v}" for v in values]
        return out + ([f"hash_{i}" for i in range(HASHED_FEATURES)] if self.hashed else [])


def nested_samples(df: DataFrame, key: str, shares: Sequence[float], seed: int | str) -> list[tuple[float, DataFrame]]:
    """Growing subsets, each holding the one before: rows whose draw is below the share."""
    return [(share, df.where(uniform(key, seed) < share) if share < 1 else df) for share in shares]
