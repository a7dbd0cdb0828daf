"""Find personal data by column names and by what the values look like."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.scalars import beside
from sluice.functions.text import plain_text, stars
from sluice.functions.types import FLOATS, INTEGERS
from sluice.session import small_frame

# Keyword, category, severity and confidence. A column whose name
# contains the keyword is a candidate; the order decides between equals.
NAME_RULES = (
    ("ssn", "national_id", "critical", 0.90),
    ("social_security", "national_id", "critical", 0.92),
    ("national_id", "national_id", "critical", 0.88),
    ("passport", "national_id", "critical", 0.85),
    ("drivers_license", "national_id", "critical", 0.85),
    ("license_number", "national_id", "critical", 0.80),
    ("tax_id", "national_id", "critical", 0.85),
    ("nhs", "national_id", "critical", 0.85),
    ("credit_card", "financial", "critical", 0.92),
    ("card_number", "financial", "critical", 0.90),
    ("cvv", "financial", "critical", 0.88),
    ("iban", "financial", "critical", 0.90),
    ("account_number", "financial", "critical", 0.82),
    ("bank_account", "financial", "critical", 0.85),
    ("routing_number", "financial", "critical", 0.85),
    ("diagnosis", "health", "critical", 0.85),
    ("icd", "health", "critical", 0.80),
    ("condition", "health", "critical", 0.72),
    ("medication", "health", "critical", 0.80),
    ("prescription", "health", "critical", 0.82),
    ("medical_record", "health", "critical", 0.85),
    ("patient_id", "health", "critical", 0.80),
    ("email", "contact", "high", 0.92),
    ("e_mail", "contact", "high", 0.90),
    ("phone", "contact", "high", 0.88),
    ("mobile", "contact", "high", 0.85),
    ("telephone", "contact", "high", 0.85),
    ("tel", "contact", "high", 0.75),
    ("address", "contact", "high", 0.78),
    ("street", "contact", "high", 0.75),
    ("city", "contact", "high", 0.60),
    ("ip_address", "contact", "high", 0.88),
    ("ip", "contact", "high", 0.72),
    ("mac_address", "contact", "high", 0.85),
    ("latitude", "geolocation", "high", 0.85),
    ("longitude", "geolocation", "high", 0.85),
    ("lat", "geolocation", "high", 0.70),
    ("lng", "geolocation", "high", 0.70),
    ("gps", "geolocation", "high", 0.80),
    ("location", "geolocation", "high", 0.65),
    ("dob", "quasi_identifier", "high", 0.90),
    ("date_of_birth", "quasi_identifier", "high", 0.92),
    ("birth_date", "quasi_identifier", "high", 0.90),
    ("birthdate", "quasi_identifier", "high", 0.90),
    ("age", "quasi_identifier", "low", 0.65),
    ("gender", "quasi_identifier", "medium", 0.75),
    ("sex", "quasi_identifier", "medium", 0.65),
    ("race", "quasi_identifier", "high", 0.78),
    ("ethnicity", "quasi_identifier", "high", 0.80),
    ("religion", "quasi_identifier", "high", 0.78),
    ("nationality", "quasi_identifier", "medium", 0.72),
    ("zip", "quasi_identifier", "medium", 0.80),
    ("postal", "quasi_identifier", "medium", 0.78),
    ("postcode", "quasi_identifier", "medium", 0.80),
    ("first_name", "name", "medium", 0.85),
    ("last_name", "name", "medium", 0.85),
    ("full_name", "name", "medium", 0.88),
    ("surname", "name", "medium", 0.85),
    ("given_name", "name", "medium", 0.85),
    ("username", "name", "low", 0.70),
    ("user_id", "identifier", "low", 0.60),
    ("customer_id", "identifier", "low", 0.62),
    ("device_id", "identifier", "medium", 0.72),
    ("fingerprint", "biometric", "critical", 0.80),
    ("biometric", "biometric", "critical", 0.85),
    ("face", "biometric", "critical", 0.75),
    ("voice", "biometric", "critical", 0.75),
    ("salary", "financial", "high", 0.82),
    ("income", "financial", "high", 0.78),
    ("wage", "financial", "high", 0.78),
    ("salary_band", "financial", "medium", 0.75),
    ("cookie", "behavioral", "medium", 0.72),
    ("session_id", "behavioral", "medium", 0.68),
    ("token", "behavioral", "medium", 0.60),
)

# Pattern, category, severity and confidence, in the order that
# decides between equals.
VALUE_RULES = (
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "contact", "high", 0.95),
    (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "contact", "high", 0.80),
    (r"\b\d{3}-\d{2}-\d{4}\b", "national_id", "critical", 0.95),
    (r"\b4[0-9]{12}(?:[0-9]{3})?\b", "financial", "critical", 0.90),
    (r"\b5[1-5][0-9]{14}\b", "financial", "critical", 0.90),
    (r"\b3[47][0-9]{13}\b", "financial", "critical", 0.90),
    (r"\b(?:[0-9]{4}[- ]?){3}[0-9]{4}\b", "financial", "critical", 0.85),
    (
        r"\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
        "contact", "high", 0.92,
    ),
    (r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}(?:[A-Z0-9]{0,16})?\b", "financial", "critical", 0.88),
    (r"\b\d{5}(?:-\d{4})?\b", "quasi_identifier", "medium", 0.55),
    (r"\b(?:19|20)\d{2}[-/]\d{2}[-/]\d{2}\b", "quasi_identifier", "high", 0.75),
    (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "contact", "high", 0.78),
)

# Fixed values
RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1, "clean": 0}
LEAST_SHARE = 0.05
SAMPLES = 3


# What a match of each pattern needs: so many characters in the text, and where all of a text is one whole
# number, one of these numbers of digits. The others need signs that a number has not.
LEAST_LENGTHS = (6, 10, 11, 13, 16, 15, 16, 7, 15, 5, 10, 10)
DIGITS = ((), (10,), (), (13, 16), (16,), (15,), (16,), (), (), (5,), (), (10, 11))
FLOAT_RULES = frozenset({1, 3, 4, 5, 6, 9, 11})  # those that need one point at most, and no letters or hyphens

RULE = "array<struct<rank: int, rule_no: int, category: string, severity: string, confidence: double, mark: string>>"


def _rules(rules: Sequence[tuple[str, str, str, float]]) -> Column:
    """Rules as one constant array; the smallest entry is the best: high rank, then early."""
    entries = [
        {"rank": -RANKS[severity], "rule_no": i, "category": category, "severity": severity, "confidence": confidence,
         "mark": mark}
        for i, (mark, category, severity, confidence) in enumerate(rules)
    ]
    return F.from_json(F.lit(json.dumps(entries)), RULE)


def name_signal(name: Column) -> Column:
    """The best name rule whose keyword occurs in ``name``, or null."""
    lowered = F.lower(name)
    return F.array_min(F.filter(_rules(NAME_RULES), lambda rule: F.contains(lowered, rule["mark"])))


def value_matches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, ordinal, values`` and the number of values matching each pattern (``m1..m12``).

    One pass over whole values, counted inside one aggregate.
    """
    columns = list(columns or df.columns)
    kinds = [df.schema[c].dataType for c in columns]
    texts = df.select(*[plain_text(df, c).alias(f"t{i}") for i, c in enumerate(columns)])
    # what a text needs at least: an @ for the first pattern, some digits for all others
    texts = texts.withColumns(
        {f"l{i}": F.length(f"t{i}") - F.startswith(f"t{i}", F.lit("-")).cast("int") if isinstance(kind, INTEGERS) else F.length(f"t{i}") for i, kind in enumerate(kinds)}
        | {f"mail{i}": F.contains(f"t{i}", F.lit("@")) for i, kind in enumerate(kinds) if not isinstance(kind, (*INTEGERS, *FLOATS))}
        | {f"digits{i}": F.col(f"t{i}").rlike(r"[0-9]{3}|[0-9]\.[0-9]") for i, kind in enumerate(kinds) if not isinstance(kind, (*INTEGERS, *FLOATS))}
    )
    counts = [F.count(f"t{i}").alias(f"n{i}") for i in range(len(columns))]
    for i, kind in enumerate(kinds):
        for j, rule in enumerate(VALUE_RULES):
            if isinstance(kind, INTEGERS):
                possible = F.col(f"l{i}").isin(*DIGITS[j]) if DIGITS[j] else F.lit(False)
            elif isinstance(kind, FLOATS):
                possible = F.col(f"l{i}") >= LEAST_LENGTHS[j] if j in FLOAT_RULES else F.lit(False)
            else:
                possible = (F.col(f"l{i}") >= LEAST_LENGTHS[j]) & F.col(f"mail{i}" if j == 0 else f"digits{i}")
            counts.append(F.count_if(possible & F.col(f"t{i}").rlike(rule[0])).alias(f"c{i}_{j}"))
    entries = [
        F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("ordinal"), F.col(f"n{i}").alias("values"),
            *[F.col(f"c{i}_{j}").alias(f"m{j + 1}") for j in range(len(VALUE_RULES))],
        )
        for i, c in enumerate(columns)
    ]
    return texts.agg(*counts).select(F.inline(F.array(*entries)))


def value_signal() -> Column:
    """The best pattern found in at least 5 % of a column's values, or null."""
    matches = F.array(*[F.col(f"m{j + 1}") for j in range(len(VALUE_RULES))])

    def judged(rule: Column, matched: Column) -> Column:
        share = matched / F.greatest(F.col("values"), F.lit(1))
        weighed = rule["confidence"] * F.least(share * 2, F.lit(1.0))
        return F.when((matched > 0) & (share >= LEAST_SHARE), rule.withField("confidence", weighed))

    return F.array_min(F.zip_with(_rules(VALUE_RULES), matches, judged))


def suggested_methods(category: Column, severity: Column) -> Column:
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return (
        F.when(severity == "critical", pair("hash", "suppress"))
        .when(category == "contact", pair("mask", "hash"))
        .when(category.isin("quasi_identifier", "name"), pair("generalize", "pseudonymize"))
        .when(category == "financial", pair("hash", "suppress"))
        .when(category == "health", pair("hash", "redact"))
        .otherwise(pair("redact", "suppress"))
    )


def masked_sample(value: Column) -> Column:
    """A value cut down so that a report may show it."""
    parts = F.split(value, "@")
    second = F.element_at(parts, 2)
    mail = F.concat(
        F.substring(F.element_at(parts, 1), 1, 1), F.lit("***@"), F.substring(second, 1, 1), F.lit("***."),
        F.element_at(F.split(second, r"\."), -1),
    )
    length = F.length(value)
    return (
        F.when(length <= 2, "***")
        .when(F.contains(value, F.lit("@")), mail)
        .otherwise(F.concat(F.substring(value, 1, 1), stars(length - 2), F.substring(value, -1, 1)))
    )


def combine(matches: DataFrame) -> DataFrame:
    """One finding per column that either signal points at."""
    both = matches.withColumn("by_name", name_signal(F.col("column"))).withColumn("by_value", value_signal())
    name, value = F.col("by_name"), F.col("by_value")
    either = both.where(name.isNotNull() | value.isNotNull())
    two = name.isNotNull() & value.isNotNull()
    severity = (
        F.when(two, F.when(name["rank"] <= value["rank"], name["severity"]).otherwise(value["severity"]))
        .when(name.isNotNull(), name["severity"])
        .otherwise(value["severity"])
    )
    confidence = (
        F.when(two, F.least((name["confidence"] + value["confidence"]) / 2 + 0.05, F.lit(1.0)))
        .when(name.isNotNull(), name["confidence"])
        .otherwise(value["confidence"])
    )
    method = F.when(two, "name_and_value").when(name.isNotNull(), "column_name").otherwise("value_pattern")
    return either.select(
        "ordinal", "column", F.coalesce(name["category"], value["category"]).alias("pii_category"),
        severity.alias("severity"), F.round(confidence, 3).alias("confidence"), method.alias("detection_method"),
    ).withColumn("suggested_methods", suggested_methods(F.col("pii_category"), F.col("severity")))


def first_samples(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """The first three non-null values of each column by ``key``, masked.

    Each of three narrow aggregates takes the smallest key after the last one,
    so nothing is sorted and no value list is ever held.
    """
    if not columns:
        return small_frame(df.sparkSession, [], "column string, sample_values array<string>")
    texts = df.select(F.col(key).alias("__key"), *[plain_text(df, c).alias(f"t{i}") for i, c in enumerate(columns)])
    rounds: list[dict] = []
    for _ in range(SAMPLES):
        wanted = []
        for i in range(len(columns)):
            usable = F.col(f"t{i}").isNotNull()
            if rounds and rounds[-1][i] is None:
                usable = F.lit(False)
            elif rounds:
                usable = usable & (F.col("__key") > F.lit(rounds[-1][i]["k"]))
            pair = F.struct(F.col("__key").alias("k"), masked_sample(F.col(f"t{i}")).alias("v"), (F.col(f"t{i}") == "").alias("e"))
            wanted.append(F.min(F.when(usable, pair)).alias(f"s{i}"))
        row = texts.agg(*wanted).first()  # one row
        rounds.append({i: row[f"s{i}"] for i in range(len(columns))})
    found = [
        (c, [r[i]["v"] for r in rounds if r[i] is not None and not r[i]["e"]]) for i, c in enumerate(columns)
    ]
    return small_frame(df.sparkSession, found, "column string, sample_values array<string>")


def findings(df: DataFrame, key: str | None = None) -> DataFrame:
    """Findings of one table, over all rows and all columns; with ``key`` also samples."""
    found = combine(value_matches(df))
    if key is None:
        return found
    rows = found.collect()  # at most one row per column
    local = small_frame(df.sparkSession, [tuple(r) for r in rows], found.schema)
    samples = first_samples(df, [r["column"] for r in rows], key)
    return local.join(samples, "column", "left")


def rollup(findings: DataFrame, rows_scanned: Column | int) -> DataFrame:
    """One row per scan: findings by severity and the overall risk."""
    level = lambda s: F.count_if(F.col("severity") == s)
    counts = findings.agg(
        F.count(F.lit(1)).alias("pii_column_count"),
        *[level(s).alias(f"{s}_count") for s in ("critical", "high", "medium", "low")],
    )
    risk = F.lit("clean")
    for s in ("low", "medium", "high", "critical"):
        risk = F.when(F.col(f"{s}_count") > 0, s).otherwise(risk)
    rows = rows_scanned if isinstance(rows_scanned, Column) else F.lit(rows_scanned)
    return counts.withColumn("overall_risk", risk).withColumn("rows_sampled", rows.cast("bigint"))


def scan(df: DataFrame) -> DataFrame:
    """The scan record of one table, with its findings, worst first."""
    matches = value_matches(df)
    found = combine(matches)
    entry = F.struct(
        (-rank_of(F.col("severity"))).alias("r"), "ordinal", "column", "pii_category", "severity", "confidence",
        "detection_method", "suggested_methods",
    )
    listed = found.agg(F.array_sort(F.collect_list(entry)).alias("findings"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return beside(rollup(found, total), listed)


def rank_of(severity: Column) -> Column:
    ranks = F.create_map(*[x for s, r in RANKS.items() for x in (F.lit(s), F.lit(r))])
    return F.coalesce(ranks[severity], F.lit(0))


def scan_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Findings of several tables as one lazy union."""
    parts = [findings(df).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
