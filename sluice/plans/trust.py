"""Whether data can be trusted: label noise, formats, reasons for missing values, odd rows, and synthetic rows against real ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import fidelity, missingness, noise, outliers, quality, standardize
from sluice.plans import learning
from sluice.plans import quality as scans
from sluice.plans.tables import ORDERS, Derived, table

# --- labels --------------------------------------------------------------------------

CLASSES = ("a", "b", "c")
# class probabilities of every line, and labels that often follow them
NOISY = Derived(
    "lineitem",
    {
        **learning.WEIGHTS.columns,
        "label": "CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN l_partkey % 8 = 0 THEN 'c' WHEN l_quantity > 12 THEN 'a' WHEN l_linenumber > 3 THEN 'b' ELSE 'c' END",
    },
)


def _judged(s: SparkSession, d: str) -> DataFrame:
    rows = NOISY.frame(s, d).select("row_key", "label", F.array("a", "b", "c").alias("probabilities"))
    return noise.judged_labels(rows, "label", "probabilities", CLASSES)


def _noisy_documents(s: SparkSession, d: str) -> DataFrame:
    """Quality labels of documents that models of the other folds speak against."""
    train = learning.training_rows(s, d)
    columns = learning.feature_names(s, d)
    found = noise.label_issues(train, "quality", columns, "doc_id")
    return found.select("doc_id", F.col("quality").cast("string").alias("label"), "suggested", "self_confidence", "is_issue")


# --- formats -------------------------------------------------------------------------

_DAY = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))"
_Y, _M, _D = f"substr({_DAY}, 1, 4)", f"substr({_DAY}, 6, 2)", f"substr({_DAY}, 9, 2)"
_N = "CAST(o_orderkey % 900 AS VARCHAR(10))"
MIXED = Derived(
    "orders",
    {
        "o_orderkey": "o_orderkey",
        "day": f"CASE o_orderkey % 10 WHEN 0 THEN {_DAY} WHEN 1 THEN concat({_D}, '/', {_M}, '/', {_Y}) WHEN 2 THEN concat({_Y}, '/', {_M}, '/', {_D}) "
        f"WHEN 3 THEN concat({_Y}, {_M}, {_D}) WHEN 4 THEN concat(' ', {_D}, '.', {_M}, '.', {_Y}) WHEN 5 THEN 'next week' WHEN 6 THEN '2024-02-31' "
        f"WHEN 7 THEN concat({_DAY}, 'T08:09:10') WHEN 8 THEN '' ELSE concat({_DAY}, ' 11:12:13') END",
        "amount": f"CASE o_orderkey % 7 WHEN 0 THEN concat('$', {_N}, ',500.25') WHEN 1 THEN concat('(', {_N}, '.5)') WHEN 2 THEN concat({_N}, ' %') "
        f"WHEN 3 THEN 'a lot' WHEN 4 THEN NULL ELSE concat('-', {_N}) END",
        "urgent": "CASE o_orderkey % 11 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'perhaps' ELSE 'f' END",
        "priority": "CASE o_custkey % 6 WHEN 0 THEN 'HIGH-prio' WHEN 1 THEN 'urgent' WHEN 2 THEN ' Low_Prio' WHEN 3 THEN 'whatever' ELSE 'low' END",
        "status": "o_orderstatus",
    },
)
RULES = (
    standardize.Dates("day"), standardize.Numbers("amount"), standardize.Flags("urgent"),
    standardize.Categories("priority", {"high": ("high prio", "urgent"), "low": ("low prio",)}),
)
DECOMPOSED = Derived("documents", {"doc_id": "doc_id", "text": "replace(replace(text, 'é', 'é'), ' the ', '   the\x07  ')"})


def _texts(s: SparkSession, d: str) -> DataFrame:
    rules = (standardize.Texts("text", "NFC", "lower"),)
    return standardize.good_rows(DECOMPOSED.frame(s, d), rules).select("doc_id", F.length("text").cast("bigint").alias("length"), F.md5("text").alias("digest"))


# --- missing values and odd rows -----------------------------------------------------

GAPS = Derived(
    "lineitem",
    {
        "l_quantity": "CASE WHEN l_orderkey * 7919 % 101 < 9 THEN NULL ELSE l_quantity END",
        "l_extendedprice": "l_extendedprice",
        "l_discount": "CASE WHEN l_tax > 0.05 AND l_orderkey % 3 = 0 THEN NULL ELSE l_discount END",
        "l_tax": "l_tax",
        "l_returnflag": "CASE WHEN l_linestatus = 'F' AND l_orderkey % 4 = 0 THEN NULL ELSE l_returnflag END",
        "l_linestatus": "l_linestatus",
        "l_linenumber": "CASE WHEN l_orderkey = 3 THEN NULL ELSE l_linenumber END",
    },
)
ODD = Derived(
    "lineitem",
    {
        "row_key": "l_orderkey * 10 + l_linenumber",
        "price": "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END",
        "quantity": "CASE WHEN l_orderkey % 97 = 0 THEN l_quantity * 400 + 1000 WHEN l_orderkey % 89 = 0 THEN NULL ELSE l_quantity END",
        "bell": "CASE WHEN l_orderkey % 1999 = 0 THEN 2 ELSE 0 END + (l_partkey * 7919 % 1000 + l_orderkey * 104729 % 1000 + l_suppkey * 1299709 % 1000 + l_partkey * 15485863 % 997) / CAST(1000 AS DOUBLE)",
        "fixed": "7",
    },
)
ODD_COLUMNS = ("price", "quantity", "bell", "fixed")
CRITICAL = (("total", 95.0, 10.0), ("priority", 100.0, 6.0), ("no_such_column", 50.0, 3.0), ("order_id", 90.0, 20.0))
OWN_WEIGHTS = {"completeness": 3.0, "accuracy": 1.0, "label_quality": 1.0}


def _weighted(s: SparkSession, d: str) -> DataFrame:
    scan = quality.Scan(ORDERS.frame(s, d))
    columns = quality.column_scores(scan.facts, scan.issues())
    return quality.weighted_score(scan.scores(), columns, OWN_WEIGHTS, CRITICAL)


# --- synthetic rows ------------------------------------------------------------------

REAL = Derived("lineitem", {c: c for c in ("l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus")})
MADE = {"l_quantity": "l_quantity + l_orderkey % 3", "l_extendedprice": "l_extendedprice * 1.1", "l_returnflag": "CASE WHEN l_orderkey % 9 = 1 THEN 'X' ELSE l_returnflag END"}
NUMBERS, NAMES = ("l_quantity", "l_extendedprice", "l_tax"), ("l_returnflag", "l_linestatus")


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = REAL.frame(s, d)
    return rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1").withColumns({c: F.expr(e) for c, e in MADE.items()})


def _usefulness(s: SparkSession, d: str) -> DataFrame:
    """Order statuses told by a model trained on real orders, and by one trained on orders with altered prices."""
    picks = "o_orderkey", "o_totalprice", "o_orderpriority", "CAST(month(o_orderdate) AS DOUBLE) AS month", "CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS size"
    real = table(s, d, "orders").selectExpr(*picks)
    made = real.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 1.05)
    return fidelity.usefulness(real, made, "size", "o_orderkey").select("trained_on", "status", "train_rows", "test_rows", F.col("score").between(0.5, 1.0).alias("better_than_chance"))


def _nearest(s: SparkSession, d: str) -> DataFrame:
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")
    return fidelity.nearest_real(vectors.where("vec_id % 4 <> 0"), vectors.where("vec_id % 4 = 0"), "vec_id", "embedding")


QUERIES = {
    "noise_issues": lambda s, d: noise.ranked_issues(_judged(s, d), "row_key", "label").withColumn("self_confidence", F.round("self_confidence", 6)),
    "noise_joint": lambda s, d: noise.confident_joint(_judged(s, d), "label"),
    "noise_rates": lambda s, d: noise.noise_rates(noise.confident_joint(_judged(s, d), "label")),
    "noise_documents": _noisy_documents,
    "std_good": lambda s, d: standardize.good_rows(MIXED.frame(s, d), RULES),
    "std_rejects": lambda s, d: standardize.rejects(MIXED.frame(s, d), RULES),
    "std_texts": _texts,
    "miss_associations": lambda s, d: missingness.associations(GAPS.frame(s, d)),
    "miss_kinds": lambda s, d: missingness.missingness(GAPS.frame(s, d)),
    "out_methods": lambda s, d: outliers.methods(ODD.frame(s, d), ODD_COLUMNS).withColumns({c: F.round(c, 4) for c in ("low", "high")}),
    "out_votes": lambda s, d: outliers.votes(ODD.frame(s, d), ODD_COLUMNS),
    "q_weighted": _weighted,
    "fid_ks": lambda s, d: fidelity.kolmogorov_smirnov(*_halves(s, d), NUMBERS),
    "fid_chi2": lambda s, d: fidelity.chi_square(*_halves(s, d), NAMES),
    "fid_corr": lambda s, d: fidelity.correlation_gap(*_halves(s, d), NUMBERS),
    "fid_usefulness": _usefulness,
    "fid_nearest": _nearest,
}

# --- the same in SQL -----------------------------------------------------------------

_JUDGED = f"""
t AS ({NOISY.sql}),
limits AS (SELECT avg(a) FILTER (label = 'a') AS ta, avg(b) FILTER (label = 'b') AS tb, avg(c) FILTER (label = 'c') AS tc FROM t),
judged AS (
  SELECT row_key, label, CASE WHEN a >= ta AND (b < tb OR a >= b) AND (c < tc OR a >= c) THEN 'a' WHEN b >= tb AND (c < tc OR b >= c) THEN 'b' WHEN c >= tc THEN 'c' END AS suggested,
    CASE label WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'c' THEN c END AS self FROM t, limits
)"""
_JOINT = f"""{_JUDGED},
counts AS (SELECT label AS given, suggested, count(*) AS n FROM judged WHERE label IS NOT NULL GROUP BY ALL),
sized AS (SELECT *, sum(n) OVER (PARTITION BY given) AS size, sum(n) FILTER (suggested IS NOT NULL) OVER (PARTITION BY given) AS sure FROM counts),
joint_ AS (SELECT given, suggested, n, n / sure * size AS x FROM sized WHERE suggested IS NOT NULL),
shares AS (SELECT given, suggested, CAST(n AS BIGINT) AS n, round(x / sum(x) OVER (), 6) AS share FROM joint_)"""

_SHAPES = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y/%m/%d', '%Y%m%d', '%d/%m/%Y', '%d.%m.%Y']"
_MIXED = f"""
t AS ({MIXED.sql}),
p AS (SELECT *, try_strptime(nullif(trim(day), ''), {_SHAPES}) AS day_, CASE WHEN amount LIKE '(%' THEN -1 ELSE 1 END AS f, CASE WHEN suffix(amount, '%') THEN 100 ELSE 1 END AS g,
  TRY_CAST(regexp_replace(amount, '[^0-9.a-z-]', '', 'g') AS DOUBLE) AS x,
  CASE WHEN lower(trim(urgent)) IN ('yes', 'true') THEN true WHEN lower(trim(urgent)) IN ('no', '0', 'f') THEN false END AS urgent_,
  CASE WHEN priority IN ('HIGH-prio', 'urgent') THEN 'high' WHEN priority IN (' Low_Prio', 'low') THEN 'low' END AS priority_ FROM t),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN day <> '' AND day_ IS NULL THEN 'day: no date' END, CASE WHEN amount IS NOT NULL AND x IS NULL THEN 'amount: no number' END,
  CASE WHEN urgent_ IS NULL THEN 'urgent: no flag' END, CASE WHEN priority_ IS NULL THEN 'priority: no category' END], lambda z: z IS NOT NULL), '; ') AS reasons FROM p)"""

_GAP_NUMBERS, _GAP_TEXTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"), ("l_returnflag", "l_linestatus")
_GAP_COLUMNS = tuple(GAPS.columns)
_LONG = " UNION ALL ".join(
    [f"SELECT id, '{c}' AS other, CASE WHEN {c} IS NULL THEN 'missing' ELSE 'q' || list_sum([({c} > e)::INT FOR e IN list_distinct(e_{c})]) END AS bin FROM t, edges" for c in _GAP_NUMBERS]
    + [f"SELECT id, '{c}' AS other, CASE WHEN {c} IS NULL THEN 'missing' ELSE '=' || {c} END AS bin FROM t" for c in _GAP_TEXTS]
)
_ABSENT = " UNION ALL ".join(f"SELECT id, '{c}' AS col FROM t WHERE {c} IS NULL" for c in _GAP_COLUMNS)
_ASSOCIATED = f"""
t AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM ({GAPS.sql})),
edges AS (SELECT {", ".join(f"quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS e_{c}" for c in _GAP_NUMBERS)} FROM t),
long AS MATERIALIZED ({_LONG}),
absent AS MATERIALIZED ({_ABSENT}),
whole AS (SELECT other, bin, count(*) AS all_ FROM long GROUP BY ALL),
met AS (SELECT col, other, bin, count(*) AS m FROM absent JOIN long USING (id) WHERE col <> other GROUP BY ALL),
sizes AS (SELECT col, count(*) AS nulls, (SELECT count(*) FROM t) AS n FROM absent GROUP BY col),
grid AS (SELECT s.col, w.other, nulls, n, nulls / n AS p, w.bin, all_, coalesce(m, 0) AS m FROM sizes s JOIN whole w ON w.other <> s.col LEFT JOIN met ON met.col = s.col AND met.other = w.other AND met.bin = w.bin),
merged AS (SELECT col, other, nulls, n, p, CASE WHEN all_ * least(p, 1 - p) < 5 THEN 'rare' ELSE 'bin ' || bin END AS b, sum(all_) AS all_, sum(m) AS m FROM grid GROUP BY ALL),
tested AS (SELECT col, other, nulls, n, sum((m - all_ * p) * (m - all_ * p) / (all_ * p) + (m - all_ * p) * (m - all_ * p) / (all_ * (1 - p))) AS x, count(*) - 1 AS dof FROM merged GROUP BY ALL),
pairs AS (SELECT col AS "column", other, nulls, n AS rows, round(x, 6) AS chi_square, CAST(dof AS INTEGER) AS dof, round(sqrt(x / n), 6) AS cramers_v,
  round(CASE WHEN dof > 0 THEN (cbrt(x / dof) - (1 - 2 / (9 * dof))) / sqrt(2 / (9 * dof)) END, 6) AS score FROM tested)"""

_SHAPE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, avg((x - m) * (x - m) * (x - m)) / (s * s * s) AS skew, avg((x - m) * (x - m) * (x - m) * (x - m)) / (s * s * s * s) - 3 AS tails,
      quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (SELECT {c}::DOUBLE AS x, avg({c}::DOUBLE) OVER () AS m, nullif(stddev_pop({c}::DOUBLE) OVER (), 0) AS s FROM t) GROUP BY m, s"""
    for c in ODD_COLUMNS
)
_METHODS = f"""
t AS ({ODD.sql}),
shape AS ({_SHAPE}),
named AS (SELECT *, CASE WHEN n < 10 OR std = 0 THEN 'none' WHEN abs(skew) <= 0.5 AND abs(tails) <= 1 THEN 'z-score' WHEN q1 = q3 THEN 'none' ELSE 'fences' END AS method FROM shape),
methods AS (SELECT "column", method, CASE method WHEN 'z-score' THEN mean - 3 * std WHEN 'fences' THEN q1 - 3 * (q3 - q1) END AS low, CASE method WHEN 'z-score' THEN mean + 3 * std WHEN 'fences' THEN q3 + 3 * (q3 - q1) END AS high, n FROM named)"""
_ODD_FLAGS = ", ".join(f"CASE WHEN {c} < (SELECT low FROM methods WHERE \"column\" = '{c}') OR {c} > (SELECT high FROM methods WHERE \"column\" = '{c}') THEN '{c}' END" for c in ODD_COLUMNS)

_MADE = ", ".join(f"{MADE.get(c, c)} AS {c}" for c in REAL.columns)
_HALVES = f"real AS MATERIALIZED (SELECT * FROM ({REAL.sql}) WHERE l_orderkey % 2 = 0), made AS MATERIALIZED (SELECT {_MADE} FROM lineitem WHERE l_orderkey % 2 = 1)"


def _unpivoted(columns: tuple[str, ...], kind: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS {kind}) AS v, {r} AS r, {1 - r} AS s FROM {source} WHERE {c} IS NOT NULL" for c in columns for source, r in (("real", 1), ("made", 0)))


_KS_SERIES = " + ".join(f"{2.0 * (-1) ** (k - 1)} * exp({-2.0 * k * k} * x * x)" for k in range(1, 21))

SQL = {
    "noise_issues": f"WITH {_JUDGED} SELECT row_key, label, suggested, round(self, 6) AS self_confidence FROM judged WHERE label IS NOT NULL AND suggested IS NOT NULL AND suggested <> label",
    "noise_joint": f"WITH {_JOINT} SELECT * FROM shares",
    "noise_rates": f"WITH {_JOINT} SELECT given AS label, round(sum(share), 4) AS share, round(sum(share) FILTER (given <> suggested) / sum(share), 4) AS noise_rate FROM shares GROUP BY given",
    "std_good": f"WITH {_MIXED} SELECT o_orderkey, day_ AS day, x * f / g AS amount, urgent_ AS urgent, priority_ AS priority, status FROM r WHERE reasons = ''",
    "std_rejects": f"WITH {_MIXED} SELECT o_orderkey, day, amount, urgent, priority, status, reasons FROM r WHERE reasons <> ''",
    "std_texts": f"""WITH t AS ({DECOMPOSED.sql}), n AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[\\s\\x{{00A0}}]+', ' ', 'g'))) AS text FROM t)
        SELECT doc_id, length(text) AS length, md5(text) AS digest FROM n""",
    "miss_associations": f"WITH {_ASSOCIATED} SELECT * FROM pairs",
    "miss_kinds": f"""WITH {_ASSOCIATED}, best AS (SELECT "column", max(nulls) AS nulls, max(rows) AS rows, max({{'v': cramers_v, 'o': other}}) FILTER (score > 3.09 AND cramers_v >= 0.1) AS m FROM pairs GROUP BY 1),
        names AS (SELECT unnest({list(_GAP_COLUMNS)}) AS "column"), k AS (SELECT "column", coalesce(nulls, 0) AS nulls, m, CASE WHEN nulls IS NULL THEN 'none' WHEN least(nulls, rows - nulls) < 30 THEN 'unknown' WHEN m IS NOT NULL THEN 'MAR' ELSE 'MCAR' END AS kind FROM names LEFT JOIN best USING ("column"))
        SELECT "column", CAST(nulls AS BIGINT) AS nulls, kind, CASE WHEN kind = 'MAR' THEN m.o END AS depends_on, CASE WHEN kind = 'MAR' THEN m.v END AS cramers_v FROM k""",
    "out_methods": f"WITH {_METHODS} SELECT \"column\", method, round(low, 4) AS low, round(high, 4) AS high, n FROM methods",
    "out_votes": f"WITH {_METHODS}, v AS (SELECT *, list_filter([{_ODD_FLAGS}], lambda z: z IS NOT NULL) AS w FROM t) SELECT row_key, price, quantity, bell, fixed, array_to_string(w, ',') AS voters, CAST(len(w) AS INTEGER) AS votes FROM v WHERE len(w) >= 2",
    "q_weighted": f"""WITH o AS ({scans.SQL["q_overall"]}), c AS ({scans.SQL["q_column_score"]}), r AS (SELECT * FROM (VALUES {", ".join(map(str, CRITICAL))}) AS v(name, least, points)),
        l AS (SELECT round(sum(points * greatest(0, least - coalesce(quality_score, 0)) / least), 2) AS penalty FROM r LEFT JOIN c ON c."column" = r.name),
        b AS (SELECT round((3 * completeness + accuracy + label_quality) / 5, 1) AS base, penalty FROM o, l) SELECT base, CAST(penalty AS DOUBLE) AS penalty, CAST(round(greatest(0, least(100, base - penalty)), 1) AS DOUBLE) AS final FROM b""",
    "fid_ks": f"""WITH {_HALVES}, u AS ({_unpivoted(NUMBERS, "DOUBLE")}), c AS (SELECT "column", v, sum(r) AS r, sum(s) AS s FROM u GROUP BY ALL),
        f AS (SELECT "column", sum(r) OVER w AS a, sum(s) OVER w AS b, sum(r) OVER p AS n, sum(s) OVER p AS m FROM c WINDOW w AS (PARTITION BY "column" ORDER BY v), p AS (PARTITION BY "column")),
        d AS (SELECT "column", n, m, max(abs(a / n - b / m)) AS d FROM f GROUP BY ALL), e AS (SELECT *, sqrt(n * m / (n + m)) AS z FROM d), g AS (SELECT *, (z + 0.12 + 0.11 / z) * d AS x FROM e)
        SELECT "column", CAST(n AS BIGINT) AS n_real, CAST(m AS BIGINT) AS n_synthetic, round(d, 6) AS statistic, round(CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0, least(1, {_KS_SERIES})) END, 6) AS p_value FROM g""",
    "fid_chi2": f"""WITH {_HALVES}, u AS ({_unpivoted(NAMES, "VARCHAR")}), c AS (SELECT "column", v, sum(r) AS r, sum(s) AS s FROM u GROUP BY ALL),
        f AS (SELECT *, sum(r) OVER p AS n, sum(s) OVER p AS m FROM c WINDOW p AS (PARTITION BY "column")), x AS (SELECT "column", n, m, sum((r - (r + s) * n / (n + m)) ** 2 / ((r + s) * n / (n + m)) + (s - (r + s) * m / (n + m)) ** 2 / ((r + s) * m / (n + m))) AS x, count(*) - 1 AS dof FROM f GROUP BY ALL)
        SELECT "column", CAST(n AS BIGINT) AS n_real, CAST(m AS BIGINT) AS n_synthetic, round(x, 6) AS statistic, CAST(dof AS INTEGER) AS dof, round(sqrt(x / (n + m)), 6) AS cramers_v FROM x""",
    "fid_corr": f"""WITH {_HALVES}, p AS ({" UNION ALL ".join(f"SELECT '{a}' AS l, '{b}' AS r, round((SELECT corr({a}, {b}) FROM real), 12) AS x, round((SELECT corr({a}, {b}) FROM made), 12) AS y" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:])})
        SELECT l AS "left", r AS "right", round(x, 6) AS real, round(y, 6) AS synthetic, round(abs(x - y), 6) AS gap, round(avg(abs(x - y)) OVER (), 6) AS mean_gap, round(max(abs(x - y)) OVER (), 6) AS largest_gap FROM p""",
    "fid_usefulness": """WITH c AS (SELECT o_totalprice > 100000 AS large, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS made FROM orders GROUP BY 1), k AS (SELECT sum(CAST(ceil(round(n * 0.2, 9)) AS BIGINT)) AS t, sum(n) AS n, sum(made) AS made FROM c)
        SELECT 'real' AS trained_on, 'complete' AS status, CAST(n - t AS BIGINT) AS train_rows, CAST(t AS BIGINT) AS test_rows, true AS better_than_chance FROM k
        UNION ALL SELECT 'synthetic', 'complete', CAST(made AS BIGINT), CAST(t AS BIGINT), true FROM k""",
}
