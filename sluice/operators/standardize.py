"""One format per column: dates, numbers, texts and categories as they come are brought to one form, or the row is rejected with its reasons."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How dates are written, in the order they are tried; days come before months.
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d'T'H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)
CURRENCIES = "$€£¥"
YES, NO = ("true", "t", "yes", "y", "1", "on"), ("false", "f", "no", "n", "0", "off")


def _blank_is_null(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


@dataclass(frozen=True)
class Dates:
    """ISO timestamps from whatever format of ``formats`` fits first."""

    name: str
    formats: Sequence[tuple[str, str]] = DATE_FORMATS
    kind = "date"

    def parsed(self) -> Column:
        text = _blank_is_null(F.col(self.name).cast("string"))
        return F.coalesce(*[F.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(shape))) for pattern, shape in self.formats])


@dataclass(frozen=True)
class Numbers:
    """Doubles from texts with currency signs, thousands separators, percent signs or brackets for negative amounts."""

    name: str
    thousands: str = ","
    decimal: str = "."
    kind = "number"

    def parsed(self) -> Column:
        text = _blank_is_null(F.col(self.name).cast("string"))
        bare = F.translate(text, CURRENCIES + self.thousands + " ()%", "")
        if self.decimal != ".":
            bare = F.translate(bare, self.decimal, ".")
        sign = F.when(text.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0)
        scale = F.when(text.endswith("%"), 100.0).otherwise(1.0)
        return bare.try_cast("double") * sign / scale


@dataclass(frozen=True)
class Flags:
    """Booleans from the usual words."""

    name: str
    kind = "flag"

    def parsed(self) -> Column:
        word = F.lower(F.trim(F.col(self.name).cast("string")))
        return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


@dataclass(frozen=True)
class Texts:
    """Text in one Unicode form, without control characters, with single spaces; in lower or upper case if asked for."""

    name: str
    form: str = "NFC"
    case: str | None = None
    kind = "text"

    def parsed(self) -> Column:
        plain = F.regexp_replace(unicode_form(F.col(self.name).cast("string"), self.form), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
        spaced = F.trim(F.regexp_replace(plain, r"[\s\u00A0]+", " "))
        return {"lower": F.lower, "upper": F.upper, None: lambda c: c}[self.case](spaced)


@dataclass(frozen=True)
class Categories:
    """One spelling per category: names and their variants, whatever their case."""

    name: str
    names: Mapping[str, Sequence[str]] = field(default_factory=dict)
    kind = "category"

    def parsed(self) -> Column:
        word = F.lower(F.regexp_replace(F.trim(F.col(self.name).cast("string")), r"[ _-]+", " "))
        out = F.lit(None).cast("string")
        for name, variants in self.names.items():
            out = F.when(word.isin(name.lower(), *[v.lower() for v in variants]), name).otherwise(out)
        return out


Rule = Dates | Numbers | Flags | Texts | Categories


#: The first code point that each normal form may change, alone or beside others.
FIRST_CHANGED = {"NFC": 0x300, "NFD": 0xC0, "NFKC": 0xA0, "NFKD": 0xA0}
AT_ONCE = 64


def unicode_form(text: Column, form: str) -> Column:
    """One of the Unicode normal forms. Spark has no function for it: an Arrow batch at a time.

    Texts that the form cannot change stay in Spark; of the others only ``AT_ONCE`` are Python objects at a time.
    """
    if form not in FIRST_CHANGED:
        raise ValueError(f"unknown form {form}")

    @F.arrow_udf("string")
    def normal(values: pa.Array) -> pa.Array:
        some = lambda at: [t if t is None else unicodedata.normalize(form, t) for t in values.slice(at, AT_ONCE).to_pylist()]
        return pa.concat_arrays([pa.array(some(at), pa.string()) for at in range(0, max(1, len(values)), AT_ONCE)])

    changed = text.rlike(rf"[^\x00-\x{{{FIRST_CHANGED[form] - 1:x}}}]")
    return F.when(changed, normal(F.when(changed, text))).otherwise(text)


def standardized(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every ruled column in its form, and ``reasons``: what could not be brought to it. One projection."""
    parsed = df.withColumns({f"__s{i}": r.parsed() for i, r in enumerate(rules)})
    given = lambda r: _blank_is_null(F.col(r.name).cast("string")).isNotNull()
    reasons = [F.when(given(r) & F.col(f"__s{i}").isNull(), F.lit(f"{r.name}: no {r.kind}")) for i, r in enumerate(rules)]
    places = {r.name: f"__s{i}" for i, r in enumerate(rules)}
    picks = [F.col(places[c]).alias(c) if c in places else F.col(c) for c in df.columns]
    return parsed.select(*picks, F.array_compact(F.array(*reasons)).alias("reasons"), F.struct(*[F.col(r.name).cast("string").alias(r.name) for r in rules]).alias("__raw"))


def good_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that all rules could read, in their form."""
    return standardized(df, rules).where(F.size("reasons") == 0).select(*df.columns)


def rejects(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The other rows as they came, with the reasons as one text."""
    ruled = {r.name for r in rules}
    back = [F.col(f"__raw.{c}").alias(c) if c in ruled else F.col(c) for c in df.columns]
    return standardized(df, rules).where(F.size("reasons") > 0).select(*back, F.concat_ws("; ", "reasons").alias("reasons"))


def write_split(df: DataFrame, rules: Sequence[Rule], path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects from one pass over ``df``, written as two parts of one table."""
    ruled = {r.name for r in rules}
    raw = F.struct(*[F.col(f"__raw.{c}").alias(c) if c in ruled else F.col(c).alias(c) for c in df.columns])
    seen = standardized(df, rules)
    bad = F.size("reasons") > 0
    seen.select(bad.cast("int").alias("rejected"), F.when(~bad, F.struct(*df.columns)).alias("good"), F.when(bad, raw).alias("raw"), F.concat_ws("; ", "reasons").alias("reasons")).write.partitionBy("rejected").parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.where("rejected = 0").select("good.*"), back.where("rejected = 1").select("raw.*", "reasons")
