"""Personal data: finding it and taking it out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import anonymize, pii
from sluice.plans.tables import Derived, table

# Contact data of every customer; formats that the given texts lack are planted.
CONTACTS = Derived(
    "customer",
    {
        "c_custkey": "c_custkey",
        "note": "CASE c_custkey % 4 WHEN 0 THEN concat('call 555-123-', lpad(cast(c_custkey % 10000 AS STRING), 4, '0')) "
        "WHEN 1 THEN concat('ssn 123-45-', lpad(cast(c_custkey % 10000 AS STRING), 4, '0')) "
        "WHEN 2 THEN concat('iban DE89', 'ABCD', lpad(cast(c_custkey % 10000000 AS STRING), 7, '0'), 'X1') "
        "ELSE concat('born 1987-03-', lpad(cast(c_custkey % 28 + 1 AS STRING), 2, '0')) END",
        "email": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat(lower(c_mktsegment), cast(c_custkey AS STRING), "
        "'@mail.example.com') END",
        "card": "CASE c_custkey % 3 WHEN 0 THEN concat('5', '1', lpad(cast(c_custkey % 1000000 AS STRING), 14, '0')) "
        "WHEN 1 THEN concat('34', lpad(cast(c_custkey % 1000000 AS STRING), 13, '0')) "
        "ELSE concat('4', lpad(cast(c_custkey % 1000000 AS STRING), 15, '0')) END",
        "zip_code": "lpad(cast(c_custkey % 100000 AS STRING), 5, '0')",
        "segment": "c_mktsegment",
        "ip_address": "concat('10.', cast(c_custkey % 256 AS STRING), '.', cast(c_nationkey AS STRING), '.7')",
        "mobile": "concat('+1 (555) 010-', lpad(cast(c_custkey % 10000 AS STRING), 4, '0'))",
    },
)

# Names as a catalog of columns would hold them, one per customer.
WORDS = (
    "shipping_zip", "Message", "USER_ID", "billing_Email", "passport_no", "home_city", "salary_band", "total",
    "session_id", "DateOfBirth_dob", "credit_card_no", "iconic",
)
NAMES = Derived(
    "customer",
    {
        "entry": "c_custkey",
        "name": "concat(CASE c_custkey % 12 "
        + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS))
        + " END, '_', cast(c_custkey AS STRING))",
    },
)

# every given table with all its columns
TEXT_TABLES = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


def _names(s: SparkSession, d: str) -> DataFrame:
    hit = pii.name_signal(F.col("name"))
    return NAMES.frame(s, d).withColumn("hit", hit).select(
        "entry", "name", F.col("hit.category").alias("category"), F.col("hit.severity").alias("severity"),
        F.col("hit.confidence").alias("confidence"),
    )


def _text_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {name: table(s, d, name).select(*columns) for name, columns in TEXT_TABLES.items()}


def _counts(s: SparkSession, d: str) -> DataFrame:
    """Matches per pattern for the planted contacts and all given texts."""
    parts = [pii.value_matches(CONTACTS.frame(s, d).drop("c_custkey")).select(F.lit("contacts").alias("table_name"), "*")]
    parts += [pii.value_matches(df).select(F.lit(n).alias("table_name"), "*") for n, df in _text_tables(s, d).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("ordinal")


def _value_signals(s: SparkSession, d: str) -> DataFrame:
    found = pii.value_matches(CONTACTS.frame(s, d).drop("c_custkey")).withColumn("hit", pii.value_signal())
    return found.select(
        "column", F.col("hit.category").alias("category"), F.col("hit.severity").alias("severity"),
        F.round("hit.confidence", 4).alias("confidence"),
    )


def _findings(s: SparkSession, d: str) -> DataFrame:
    contacts = CONTACTS.frame(s, d)
    found = pii.findings(contacts, key="c_custkey").where(F.col("column") != "c_custkey")
    return found.select(
        "column", "pii_category", "severity", "confidence", "detection_method",
        F.concat_ws("|", "suggested_methods").alias("suggested_methods"),
        F.concat_ws("|", "sample_values").alias("sample_values"),
    )


def _rollup(s: SparkSession, d: str) -> DataFrame:
    contacts = CONTACTS.frame(s, d).drop("c_custkey")
    return pii.scan(contacts).select(
        "pii_column_count", "critical_count", "high_count", "medium_count", "low_count", "overall_risk", "rows_sampled",
        F.concat_ws("|", F.col("findings.column")).alias("worst_first"),
    )


JOB = [
    {"column": "note", "method": "suppress"},
    {"column": "email", "method": "mask"},
    {"column": "card", "method": "hash"},
    {"column": "zip_code", "method": "generalize", "params": {"bucket_size": 250}},
    {"column": "segment", "method": "generalize", "params": {"top_n": 2}},
    {"column": "ip_address", "method": "redact"},
    {"column": "no_such_column", "method": "hash"},
    {"column": "mobile", "method": "keep"},
]


def _one(column: str, method: str, **params):
    config = [{"column": column, "method": method, "params": params}]
    return lambda df, key=None: anonymize.anonymize(df, config, key)


def _keep_suppress_redact(s: SparkSession, d: str) -> DataFrame:
    configs = [
        {"column": "c_name", "method": "redact"}, {"column": "c_nationkey", "method": "suppress"},
        {"column": "c_mktsegment", "method": "keep"},
    ]
    return anonymize.anonymize(table(s, d, "customer").drop("c_acctbal"), configs)


ODD = Derived(
    "customer",
    {
        "c_custkey": "c_custkey",
        "value": "CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a' WHEN 3 THEN 'ab' WHEN 4 THEN c_name "
        "WHEN 5 THEN concat('jane.doe', cast(c_custkey AS STRING), '@mail.example.org') WHEN 6 THEN 'x@host' "
        "WHEN 7 THEN 'a@b@c.de' ELSE concat('Zoë', cast(c_custkey AS STRING)) END",
    },
)

# orders with totals of up to ten digits before the point and many behind it
FINE = Derived(
    "orders",
    {
        "o_orderkey": "o_orderkey",
        "total": "CASE WHEN o_orderkey % 7 = 0 THEN 12345678.1234561 + CAST(o_orderkey % 3 AS DOUBLE) * 3e-7 "
        "WHEN o_orderkey % 7 = 1 THEN o_totalprice / 100000000e0 WHEN o_orderkey % 7 = 2 THEN o_totalprice * 1000e0 ELSE o_totalprice END",
    },
)

QUERIES = {
    "pii_names": _names,
    "pii_value_counts": _counts,
    "pii_value_signal": _value_signals,
    "pii_findings": _findings,
    "pii_rollup": _rollup,
    "pii_all_tables": lambda s, d: pii.scan_tables(_text_tables(s, d)).select(
        "table_name", "column", "pii_category", "severity", "confidence", "detection_method"
    ),
    "anon_keep_suppress_redact": _keep_suppress_redact,
    "anon_mask": lambda s, d: _one("value", "mask")(ODD.frame(s, d)),
    "anon_hash": lambda s, d: _one("text", "hash")(table(s, d, "documents").select("doc_id", "text")),
    "anon_hash_numbers": lambda s, d: _one("o_custkey", "hash")(table(s, d, "orders").select("o_orderkey", "o_custkey")),
    "anon_hash_double": lambda s, d: _one("total", "hash")(FINE.frame(s, d)),
    "anon_pseudonym_double": lambda s, d: _one("total", "pseudonymize")(FINE.frame(s, d), "o_orderkey"),
    "anon_bucket": lambda s, d: _one("p_size", "generalize", bucket_size=7)(table(s, d, "part").select("p_partkey", "p_size")),
    "anon_bucket_double": lambda s, d: _one("c_acctbal", "generalize", bucket_size=500)(
        table(s, d, "customer").select("c_custkey", "c_acctbal")
    ),
    "anon_topn": lambda s, d: _one("p_brand", "generalize")(table(s, d, "part").select("p_partkey", "p_brand")),
    "anon_pseudonym": lambda s, d: _one("l_suppkey", "pseudonymize")(
        table(s, d, "lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_key"), "l_suppkey"
        ),
        "row_key",
    ),
    "anon_job": lambda s, d: anonymize.anonymize(CONTACTS.frame(s, d), JOB),
    "anon_job_summary": lambda s, d: anonymize.job_summary(CONTACTS.frame(s, d), JOB),
}

# --- the same in SQL ----------------------------------------------------------

_CT = f"WITH t AS MATERIALIZED ({CONTACTS.sql})"
_CONTACT_COLUMNS = [c for c in CONTACTS.columns if c != "c_custkey"]
_RULES = ", ".join(
    f"({i}, '{k}', '{c}', '{s}', {f}, {pii.RANKS[s]})" for i, (k, c, s, f) in enumerate(pii.NAME_RULES)
)
_RULE_TABLE = f"rules(no, keyword, category, severity, confidence, rnk) AS (VALUES {_RULES})"


def _match_row(name: str, source: str, column: str) -> str:
    counts = ", ".join(
        f"count(*) FILTER (regexp_matches(CAST({column} AS VARCHAR), '{rule[0]}')) AS m{j + 1}" for j, rule in enumerate(pii.VALUE_RULES)
    )
    return f"""SELECT '{name}' AS table_name, '{column}' AS "column", count({column}) AS "values", {counts} FROM {source}"""


_CONTACT_MATCHES = " UNION ALL ".join(_match_row("contacts", "t", c) for c in _CONTACT_COLUMNS)
_TEXT_MATCHES = " UNION ALL ".join(_match_row(n, n, c) for n, columns in TEXT_TABLES.items() for c in columns)


def _signals(matches: str) -> str:
    """CTEs that judge a table of matches by both kinds of rule."""
    long = " UNION ALL ".join(
        f"""SELECT table_name, "column", {j} AS no, '{c}' AS category, '{s}' AS severity, {pii.RANKS[s]} AS rnk,
        m{j + 1} * 1.0 / greatest("values", 1) AS share, {f}::DOUBLE AS base FROM m"""
        for j, (_, c, s, f) in enumerate(pii.VALUE_RULES)
    )
    return f"""m AS MATERIALIZED ({matches}), {_RULE_TABLE},
    lv AS ({long}),
    bv AS (SELECT * FROM (SELECT *, base * least(share::DOUBLE * 2, 1) AS confidence, row_number() OVER (PARTITION BY table_name,
        "column" ORDER BY rnk DESC, no) AS place FROM lv WHERE share > 0 AND share >= 0.05) WHERE place = 1),
    bn AS (SELECT * FROM (SELECT m.table_name, m."column", r.*, row_number() OVER (PARTITION BY m.table_name, m."column"
        ORDER BY r.rnk DESC, r.no) AS place FROM m JOIN rules r ON contains(lower(m."column"), r.keyword)) WHERE place = 1),
    found AS (SELECT m.table_name, m."column", coalesce(bn.category, bv.category) AS pii_category,
        CASE WHEN bn.no IS NULL THEN bv.severity WHEN bv.no IS NULL OR bn.rnk >= bv.rnk THEN bn.severity ELSE bv.severity END
            AS severity,
        round(CASE WHEN bn.no IS NULL THEN bv.confidence WHEN bv.no IS NULL THEN bn.confidence::DOUBLE
            ELSE least((bn.confidence::DOUBLE + bv.confidence) / 2 + 0.05, 1) END, 3) AS confidence,
        CASE WHEN bn.no IS NULL THEN 'value_pattern' WHEN bv.no IS NULL THEN 'column_name' ELSE 'name_and_value' END
            AS detection_method
        FROM m LEFT JOIN bn USING (table_name, "column") LEFT JOIN bv USING (table_name, "column")
        WHERE bn.no IS NOT NULL OR bv.no IS NOT NULL)"""


_SAMPLE = """CASE WHEN length({v}) <= 2 THEN '***' WHEN contains({v}, '@') THEN substr(split_part({v}, '@', 1), 1, 1) || '***@'
    || substr(split_part({v}, '@', 2), 1, 1) || '***.' || list_extract(string_split(split_part({v}, '@', 2), '.'), -1)
    ELSE substr({v}, 1, 1) || repeat('*', length({v}) - 2) || substr({v}, -1, 1) END"""
_SAMPLES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", string_agg({_SAMPLE.format(v=c)}, '|' ORDER BY c_custkey) AS sample_values
    FROM (SELECT c_custkey, {c} FROM t WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 3)"""
    for c in _CONTACT_COLUMNS
)
_SUGGEST = """CASE WHEN severity = 'critical' THEN 'hash|suppress' WHEN pii_category = 'contact' THEN 'mask|hash'
    WHEN pii_category IN ('quasi_identifier', 'name') THEN 'generalize|pseudonymize'
    WHEN pii_category = 'financial' THEN 'hash|suppress' WHEN pii_category = 'health' THEN 'hash|redact'
    ELSE 'redact|suppress' END"""
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_MAIL = """substr(v, 1, 1) || repeat('*', greatest(length(loc) - 1, 1)) || '@' || substr(host, 1, 1)
    || repeat('*', greatest(length(host) - 1, 1)) || suffix"""

SQL = {
    "pii_names": f"""WITH t AS ({NAMES.sql}), {_RULE_TABLE}, r AS (SELECT t.*, category, severity, confidence, row_number()
        OVER (PARTITION BY entry ORDER BY rnk DESC NULLS LAST, no) AS place FROM t LEFT JOIN rules
        ON contains(lower(name), keyword)) SELECT entry, name, category, severity, confidence::DOUBLE AS confidence
        FROM r WHERE place = 1""",
    "pii_value_counts": f"{_CT} {_CONTACT_MATCHES} UNION ALL {_TEXT_MATCHES}",
    "pii_value_signal": f"""{_CT}, {_signals(_CONTACT_MATCHES)} SELECT m."column", bv.category, bv.severity,
        round(bv.confidence, 4) AS confidence FROM m LEFT JOIN bv USING ("column")""",
    "pii_findings": f"""{_CT}, {_signals(_CONTACT_MATCHES)}, s AS ({_SAMPLES}) SELECT "column", pii_category, severity,
        confidence, detection_method, {_SUGGEST} AS suggested_methods, sample_values FROM found LEFT JOIN s USING ("column")""",
    "pii_rollup": f"""{_CT}, {_signals(_CONTACT_MATCHES)} SELECT count(*) AS pii_column_count,
        count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count,
        count(*) FILTER (severity = 'medium') AS medium_count, count(*) FILTER (severity = 'low') AS low_count,
        CASE max({_RANK}) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'clean' END
            AS overall_risk, (SELECT count(*) FROM t) AS rows_sampled,
        string_agg("column", '|' ORDER BY {_RANK} DESC, list_position({_CONTACT_COLUMNS}, "column")) AS worst_first FROM found""",
    "pii_all_tables": f"""WITH {_signals(_TEXT_MATCHES)} SELECT table_name, "column", pii_category, severity, confidence,
        detection_method FROM found""",
    "anon_keep_suppress_redact": "SELECT c_custkey, '[REDACTED]' AS c_name, c_mktsegment FROM customer",
    "anon_mask": f"""WITH t AS ({ODD.sql}), p AS (SELECT c_custkey, value AS v, regexp_extract(value, '^(.*)@', 1) AS loc,
        regexp_extract(value, '@([^@]*)$', 1) AS dom FROM t), h AS (SELECT *, CASE WHEN contains(dom, '.')
        THEN regexp_extract(dom, '^(.*)\\.', 1) ELSE dom END AS host, CASE WHEN contains(dom, '.')
        THEN '.' || regexp_extract(dom, '\\.([^.]*)$', 1) ELSE '' END AS suffix FROM p)
        SELECT c_custkey, CASE WHEN v IS NULL THEN NULL WHEN contains(v, '@') THEN {_MAIL}
        WHEN length(v) <= 2 THEN repeat('*', length(v)) ELSE substr(v, 1, 1) || repeat('*', length(v) - 2) || substr(v, -1, 1)
        END AS value FROM h""",
    "anon_hash": "SELECT doc_id, substr(sha256(text), 1, 16) AS text FROM documents",
    "anon_hash_numbers": "SELECT o_orderkey, substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 16) AS o_custkey FROM orders",
    "anon_hash_double": f"WITH t AS ({FINE.sql}) SELECT o_orderkey, substr(sha256(CAST(total AS VARCHAR)), 1, 16) AS total FROM t",
    "anon_pseudonym_double": f"""WITH t AS ({FINE.sql}), v AS (SELECT total AS x, min(o_orderkey) AS first FROM t GROUP BY 1),
        n AS (SELECT x, row_number() OVER (ORDER BY first, CAST(x AS VARCHAR)) AS k FROM v)
        SELECT o_orderkey, 'ID-' || lpad(CAST(k AS VARCHAR), CAST(greatest(5, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS total
        FROM t JOIN n ON total = x""",
    "anon_bucket": """SELECT p_partkey, CAST(p_size // 7 * 7 AS VARCHAR) || '–' || CAST(p_size // 7 * 7 + 6 AS VARCHAR) AS p_size
        FROM part""",
    "anon_bucket_double": """SELECT c_custkey, CAST(b AS VARCHAR) || '–' || CAST(b + 499 AS VARCHAR) AS c_acctbal
        FROM (SELECT c_custkey, CAST(floor(c_acctbal / 500) AS BIGINT) * 500 AS b FROM customer)""",
    "anon_topn": """WITH k AS (SELECT p_brand AS v FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
        SELECT p_partkey, CASE WHEN p_brand IN (SELECT v FROM k) THEN p_brand ELSE 'Other' END AS p_brand FROM part""",
    "anon_pseudonym": """WITH v AS (SELECT CAST(l_suppkey AS VARCHAR) AS x, min(l_orderkey * 10 + l_linenumber) AS first
        FROM lineitem GROUP BY 1), n AS (SELECT x, row_number() OVER (ORDER BY first, x) AS k FROM v)
        SELECT l_orderkey * 10 + l_linenumber AS row_key, 'ID-' || lpad(CAST(k AS VARCHAR), CAST(greatest(5, length(CAST(k AS VARCHAR))) AS INTEGER), '0')
        AS l_suppkey FROM lineitem JOIN n ON CAST(l_suppkey AS VARCHAR) = x""",
    "anon_job": f"""{_CT}, k AS (SELECT segment AS v FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)
        SELECT c_custkey, CASE WHEN email IS NULL THEN NULL ELSE substr(email, 1, 1) || repeat('*', greatest(1,
            length(split_part(email, '@', 1)) - 1)) || '@m' || repeat('*', 11) || '.com' END AS email,
        substr(sha256(card), 1, 16) AS card, CAST(CAST(zip_code AS BIGINT) // 250 * 250 AS VARCHAR) || '–'
            || CAST(CAST(zip_code AS BIGINT) // 250 * 250 + 249 AS VARCHAR) AS zip_code,
        CASE WHEN segment IN (SELECT v FROM k) THEN segment ELSE 'Other' END AS segment, '[REDACTED]' AS ip_address, mobile FROM t""",
    "anon_job_summary": "SELECT count(*) AS rows_processed, 6 AS columns_transformed, 7 AS columns_out FROM customer",
}
