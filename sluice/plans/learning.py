"""Preparation, active learning and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import active, evaluation, models, preparation
from sluice.plans.tables import LINES, Derived, scratch, table
from sluice.session import small_frame

# --- rule-made inputs ------------------------------------------------------------

# class probabilities of every line: three weights that sum to 1
WEIGHTS = Derived(
    "lineitem",
    {
        "row_key": "l_orderkey * 10 + l_linenumber",
        "a": "l_quantity / (l_quantity + l_linenumber + 10)",
        "b": "l_linenumber / (l_quantity + l_linenumber + 10)",
        "c": "10 / (l_quantity + l_linenumber + 10)",
    },
)
# truth and prediction of every order
JUDGED = Derived(
    "orders",
    {
        "row_key": "o_orderkey",
        "fold": "o_custkey % 5",
        "truth": "o_orderstatus",
        "prediction": "CASE WHEN o_orderkey % 4 = 0 THEN 'P' WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END",
        "y": "o_totalprice",
        "estimate": "o_totalprice * (0.9 + (o_orderkey % 21) * 0.01)",
        "score": "(o_orderkey * 7919 % 1000) * 0.001",
        "positive": "CASE WHEN o_orderstatus = 'F' OR o_orderkey * 7919 % 1000 > 700 THEN 1 ELSE 0 END",
    },
)
TWO = Derived(
    "labels",
    {
        "doc_id": "doc_id",
        "truth": "quality",
        "prediction": "CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END",
        "toxic": "toxic",
    },
)
VOTES = Derived(
    "lineitem",
    {"row_key": "l_orderkey", "member": "l_linenumber", "vote": "CAST(l_quantity % 3 AS INTEGER)"},
)
FOLDS = Derived(
    "lineitem",
    {
        "candidate_id": "concat('c', cast(l_suppkey AS STRING))",
        "fold": "l_linenumber",
        "accuracy": "l_discount * 10",
        "f1": "l_tax * 10",
    },
)
CANDIDATES = Derived(
    "part",
    {
        "candidate_no": "p_partkey",
        "candidate_id": "concat('c', cast(p_partkey AS STRING))",
        "job": "p_brand",
        "label": "CASE WHEN p_partkey % 6 = 0 THEN concat('  mine ', cast(p_partkey AS STRING)) ELSE '' END",
        "model_type": "CASE p_size % 6 WHEN 0 THEN 'logistic_regression' WHEN 1 THEN 'random_forest' WHEN 2 THEN 'xgboost' "
        "WHEN 3 THEN 'svm' WHEN 4 THEN 'mlp' ELSE 'bayes' END",
        "preset": "CASE p_partkey % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'tuned' ELSE 'grid_search' END",
        "status": "CASE WHEN p_size % 10 = 0 THEN 'failed' ELSE 'complete' END",
        "accuracy": "CAST(p_size AS DOUBLE) / 64",
        "f1": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey * 13 % 64 AS DOUBLE) / 64 END",
        "r2": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey * 29 % 100 AS DOUBLE) / 128 END",
    },
)
RESULT_COLUMNS = ("candidate_no", "candidate_id", "status", "accuracy", "f1", "r2")
ROUNDS = Derived(
    "conversations",
    {"session_id": "conv_id", "round": "turn", "accuracy": "CAST(length(text) % 101 AS DOUBLE) / 100"},
)
SCORED = Derived(
    "customer",
    {
        "c_custkey": "c_custkey",
        "region": "CASE c_custkey % 3 WHEN 0 THEN concat(' ', lower(c_mktsegment), '-west ') WHEN 1 THEN c_mktsegment "
        "ELSE concat('north ', lower(c_mktsegment)) END",
        "plan": "CASE c_custkey % 2 WHEN 0 THEN ' PRO ' ELSE 'Basic' END",
        "probability": "CAST(c_custkey * 7919 % 1009 AS DOUBLE) / 1024",
    },
)


def _probabilities(s: SparkSession, d: str) -> DataFrame:
    return WEIGHTS.frame(s, d).select("row_key", F.array("a", "b", "c").alias("probabilities"))


def _uncertain(strategy: str):
    return lambda s, d: active.uncertain_batch(_probabilities(s, d), "row_key", 100, strategy).select(
        "row_key", F.round("score", 6).alias("score")
    )


def texts(s: SparkSession, d: str) -> DataFrame:
    """Every document with measures of its whole text, and its labels where it has some."""
    text = F.col("text")
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / F.greatest(F.length("text"), F.lit(1))
    documents = table(s, d, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.size(F.split(text, r"\s+")).alias("words"),
        share("[0-9]").alias("digits"), share(r"[^\w\s]").alias("marks"), share(r"\n").alias("breaks"),
    )
    # a few numbers per document, read again by every round and fold
    return documents.join(table(s, d, "labels"), "doc_id", "left").persist()


def training_rows(s: SparkSession, d: str) -> DataFrame:
    return texts(s, d).where("quality IS NOT NULL").drop("toxic")


def feature_names(s: SparkSession, d: str) -> list[str]:
    return preparation.feature_columns(training_rows(s, d), "quality", ["doc_id"])


def _first_labels(s: SparkSession, d: str, size: int = 120) -> DataFrame:
    """The labels of the first batch that a session would ask for."""
    train = table(s, d, "labels")
    return active.initial_batch(train, "doc_id", size).select("doc_id", F.col("quality").alias("label"))


def _round(s: SparkSession, d: str, **options) -> models.Round:
    df = texts(s, d).drop("toxic")
    return models.run_round(df, _first_labels(s, d), "doc_id", "quality", **options)


def _round_rows(s: SparkSession, d: str) -> DataFrame:
    r = _round(s, d)
    rows = [("metric", k, float(v)) for k, v in r.metrics.items()]
    rows += [("importance", k, float(v)) for k, v in r.importances]
    rows += [("confusion", f"{a}->{b}", float(n)) for a, b, n in r.confusion]
    return small_frame(s, rows, "what string, name string, value double")


def _batch(s: SparkSession, d: str) -> DataFrame:
    """The rows a model trained on the first batch is least sure of, with its confidence."""
    df, labels = texts(s, d).drop("toxic", "quality"), _first_labels(s, d)
    labelled = df.join(labels.withColumnRenamed("label", "quality"), "doc_id")
    fitted = models.fit(labelled, "quality", feature_names(s, d), "doc_id")
    pool = active.pool(df, labels, "doc_id")
    batch = active.uncertain_batch(fitted.predict(pool), "doc_id", 20, "margin")
    return models.batch_rows(df, batch, fitted, "doc_id")


def _strategies(s: SparkSession, d: str) -> DataFrame:
    """The next batch of each strategy that needs a model."""
    df = texts(s, d).drop("toxic")
    labels = _first_labels(s, d)
    columns = preparation.feature_columns(df, "quality", ["doc_id"])
    labelled = df.drop("quality").join(labels.withColumnRenamed("label", "quality"), "doc_id")
    pool = active.pool(df.drop("quality"), labels, "doc_id")
    fitted = models.fit(labelled, "quality", columns, "doc_id", model="logistic_regression")
    parts = []
    for strategy in ("entropy", "committee", "coreset", "random"):
        part = models.next_batch(strategy, fitted, labelled, pool, "quality", columns, "doc_id", 10, 1)
        parts.append(part.select(F.lit(strategy).alias("strategy"), "doc_id", "score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _variance(s: SparkSession, d: str) -> DataFrame:
    df = texts(s, d).drop("toxic", "quality", "words")
    labels = active.initial_batch(df, "doc_id", 200)
    columns = preparation.feature_columns(df, "n_chars", ["doc_id"])
    return models.prediction_variance(labels, active.pool(df, labels, "doc_id"), "n_chars", columns, "doc_id")


def _predict(s: SparkSession, d: str) -> DataFrame:
    train = training_rows(s, d)
    fitted = models.fit(train, "quality", feature_names(s, d), "doc_id", model="random_forest")
    return models.predict_all(texts(s, d).drop("quality", "toxic"), fitted)


def _coreset(s: SparkSession, d: str) -> DataFrame:
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")
    labelled = active.initial_batch(vectors, "vec_id", 10)
    picks = active.coreset_batch(active.pool(vectors, labelled, "vec_id"), labelled, "vec_id", "embedding", 5)
    return picks.withColumn("distance", F.round("distance", 5))


# two classes by rule, in five folds
TWO_FOLDS = Derived(
    "orders",
    {
        "fold": "o_orderkey % 5",
        "truth": "CASE WHEN o_custkey % 3 = 0 THEN 'yes' ELSE 'no' END",
        "prediction": "CASE WHEN (o_custkey + o_orderkey % 4) % 3 = 0 THEN 'yes' ELSE 'no' END",
    },
)

# every model under every preset, with the operator's own settings
GRID = [{"candidate_id": f"{m}_{p}", "model_type": m, "preset": p} for m in models.MODELS for p in models.PRESETS]
VALUE_MODELS = ("logistic_regression", "random_forest", "xgboost")  # the others have no regressor in Spark


def _benchmark(protocol: str, model: str):
    """One model under every preset."""

    def run(s: SparkSession, d: str) -> DataFrame:
        train = training_rows(s, d).persist()
        try:
            results, detail = models.run_benchmark(train, "quality", "doc_id", [c for c in GRID if c["model_type"] == model], protocol)
        finally:
            train.unpersist()
        named = {r.candidate_id: bool(r.importances) for r in detail}
        sizes = {r.candidate_id: sum(n for _, _, n in r.confusion) for r in detail}
        facts = small_frame(s, [(c, sizes[c], named[c]) for c in named], "candidate_id string, judged_rows bigint, has_importances boolean")
        fair = lambda c: F.col(c).between(0.0, 1.0)
        return results.join(facts, "candidate_id").select(
            "candidate_no", "candidate_id", "status", "judged_rows", "has_importances",
            (fair("accuracy") & fair("f1_weighted")).alias("scores_in_bounds"), (F.col("accuracy") > 0.5).alias("better_than_chance"),
        )

    return run


def _curve(s: SparkSession, d: str) -> DataFrame:
    rows = models.learning_curve(
        training_rows(s, d), "quality", feature_names(s, d), "doc_id", evaluation.LEARNING_SHARES, model="logistic_regression"
    )
    return small_frame(s, rows, "share double, train_score double, val_score double")


def _two_class_folds(s: SparkSession, d: str) -> DataFrame:
    """Macro scores of two classes over fixed folds, with their deviations."""
    told = TWO_FOLDS.frame(s, d)
    per_fold = evaluation.classification_metrics(told, "truth", "prediction", ["fold"], digits=12, macro=True)
    return evaluation.cv_summary(per_fold, ["accuracy", "f1", "precision", "recall"], by=())


def _regression(model: str):
    """Regression candidates on all orders' prices."""

    def run(s: SparkSession, d: str) -> DataFrame:
        orders = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.month("o_orderdate").alias("month"))
        chosen = [c for c in GRID if c["model_type"] == model]
        results = models.run_benchmark(orders, "o_totalprice", "o_orderkey", chosen, "holdout_90", "regression")[0]
        return results.select("candidate_no", "candidate_id", "status", (F.col("r2") <= 1).alias("r2_in_bounds"), (F.col("rmse") >= F.col("mae")).alias("rmse_covers_mae"))

    return run


def _holdout_sizes(share: float):
    def run(s: SparkSession, d: str) -> DataFrame:
        split = evaluation.holdout(JUDGED.frame(s, d).select("row_key", "truth"), "row_key", share, "truth")
        return split.select("row_key", "truth", "is_test")

    return run


def _auto_labels(s: SparkSession, d: str) -> DataFrame:
    candidates = CANDIDATES.frame(s, d).select("candidate_no", "label", "model_type", "preset")
    return evaluation.auto_labels(candidates, "candidate_no")


def _board(s: SparkSession, d: str) -> DataFrame:
    """The leaderboard, through its CSV export."""
    candidates = CANDIDATES.frame(s, d)
    board = evaluation.leaderboard(candidates.select(*RESULT_COLUMNS), candidates, "classification")
    path = scratch(s, "leaderboard") + ".csv"
    board.select("place", "candidate_id", "candidate_label", "model_type", "preset", "accuracy", "f1", "is_winner").write.option(
        "header", True
    ).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    schema = """place bigint, candidate_id string, candidate_label string, model_type string, preset string,
        accuracy double, f1 double, is_winner string"""
    read = s.read.csv(path, schema=schema, header=True, ignoreLeadingWhiteSpace=False, emptyValue="")
    return read.withColumns({c: F.coalesce(c, F.lit("")) for c in ("candidate_label", "is_winner")})


def _source(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "labels").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("quality")).alias("label"))
    base = table(s, d, "documents").select("doc_id", "lang", "n_chars", F.lit(None).cast("int").alias("target"))
    return evaluation.candidate_source(base, "target", "doc_id", labels=labels)


def _by_fold(s: SparkSession, d: str) -> DataFrame:
    return evaluation.classification_metrics(JUDGED.frame(s, d), by=["fold"])


QUERIES = {
    "al_numeric_prep": lambda s, d: preparation.numeric_prep(
        LINES.frame(s, d).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey"), ["l_extendedprice", "l_suppkey"]
    ).withColumns({c: F.round(c, 5) for c in ("l_extendedprice", "l_suppkey")}),
    "al_onehot": lambda s, d: preparation.one_hot(
        LINES.frame(s, d).select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_returnflag"]
    ),
    "al_onehot_frequent": lambda s, d: preparation.one_hot(
        LINES.frame(s, d).select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_returnflag"], most_frequent=True
    ),
    "al_classes": lambda s, d: preparation.classes(LINES.frame(s, d), "l_returnflag"),
    "al_classes_too_many": lambda s, d: preparation.classes(table(s, d, "events"), "user_id").agg(F.count("label").alias("n")),
    "al_label_encode": lambda s, d: preparation.label_encode(
        table(s, d, "part").select("p_partkey", "p_brand"), "p_brand"
    ),
    "al_initial": lambda s, d: active.initial_batch(table(s, d, "documents").select("doc_id", "lang"), "doc_id", 50),
    "al_pool": lambda s, d: active.pool(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id"),
    "al_random": lambda s, d: active.random_batch(
        active.pool(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id"), "doc_id", 30, 3
    ),
    **{f"al_{name}": _uncertain(name) for name in active.UNCERTAINTY},
    "al_vote_entropy": lambda s, d: active.vote_entropy(VOTES.frame(s, d), "row_key", 4).withColumn("score", F.round("score", 6)),
    "al_coreset": _coreset,
    "al_bootstrap_var": _variance,
    "al_folds": lambda s, d: evaluation.folds(table(s, d, "labels").select("doc_id", "quality"), "doc_id", 5, "quality"),
    "al_confusion": lambda s, d: evaluation.confusion_matrix(JUDGED.frame(s, d), ["F", "O", "P"]),
    "al_train": _round_rows,
    "al_batch": _batch,
    "al_strategies": _strategies,
    "al_predict": _predict,
    "al_rounds": lambda s, d: active.round_deltas(ROUNDS.frame(s, d)).withColumn("accuracy_delta", F.round("accuracy_delta", 6)),
    "al_export": lambda s, d: active.export_labels(
        table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"),
        table(s, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id",
    ),
    "al_batch_score": lambda s, d: active.scored_rows(
        active.normalized(SCORED.frame(s, d), ["region"], ["plan"]), "probability"
    ),
    "al_batch_summary": lambda s, d: active.scoring_summary(active.scored_rows(SCORED.frame(s, d), "probability")),
    "al_riskiest": lambda s, d: active.riskiest(
        active.scored_rows(SCORED.frame(s, d), "probability"), "probability", "c_custkey"
    ).select("c_custkey", "probability", "risk_level"),
    "bm_source": _source,
    "bm_holdout": _holdout_sizes(0.2),
    "bm_holdout_90": _holdout_sizes(0.1),
    "bm_kfold": lambda s, d: evaluation.folds(JUDGED.frame(s, d).select("row_key", "truth"), "row_key", 10, "truth")
    .groupBy("truth", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("row_key").alias("keys")),
    "bm_kfold_plain": lambda s, d: evaluation.folds(JUDGED.frame(s, d).select("row_key", "y"), "row_key", 5)
    .groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("row_key").alias("keys")),
    "bm_class_metrics": lambda s, d: evaluation.classification_metrics(JUDGED.frame(s, d)),
    "bm_class_metrics_binary": lambda s, d: evaluation.classification_metrics(TWO.frame(s, d)),
    "bm_auc": lambda s, d: evaluation.roc_auc(JUDGED.frame(s, d), "score", "positive"),
    "bm_reg_metrics": lambda s, d: evaluation.regression_metrics(JUDGED.frame(s, d), "y", "estimate"),
    "bm_fold_metrics": _by_fold,
    "bm_cv_two_class": _two_class_folds,
    "bm_cv_summary": lambda s, d: evaluation.cv_summary(FOLDS.frame(s, d), ["accuracy", "f1"]),
    "bm_confusion": lambda s, d: evaluation.confusion(JUDGED.frame(s, d), by=["fold"]),
    **{f"bm_grid_{m}": _benchmark("holdout_80", m) for m in models.MODELS},
    **{f"bm_cross_validated_{m}": _benchmark("kfold_5", m) for m in models.MODELS},
    **{f"bm_regression_{m}": _regression(m) for m in VALUE_MODELS},
    "bm_learning_curve": _curve,
    "bm_winner": lambda s, d: evaluation.winner(CANDIDATES.frame(s, d), "classification", ["job"]),
    "bm_winner_regression": lambda s, d: evaluation.winner(CANDIDATES.frame(s, d), "regression", ["job"]),
    "bm_leaderboard": _board,
    "bm_labels": _auto_labels,
}

# --- the same in SQL ----------------------------------------------------------------

_L = f"WITH t AS MATERIALIZED ({LINES.sql})"
_J = f"WITH t AS MATERIALIZED ({JUDGED.sql})"


def _draw(key: str, seed: str) -> str:
    return f"('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT"


def _onehot(fill: str) -> str:
    names = ["A", "N", "R"] + (["missing"] if fill == "'missing'" else [])
    flags = ", ".join(f"CAST(f = '{n}' AS INTEGER) AS l_returnflag_{n}" for n in names)
    return f"""{_L}, x AS (SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, {fill}) AS f FROM t)
        SELECT l_orderkey, l_linenumber, f AS l_returnflag, {flags} FROM x"""


def _uncertain_sql(score: str) -> str:
    return f"""WITH t AS ({WEIGHTS.sql}) SELECT row_key, round({score}, 6) AS score FROM t ORDER BY {score} DESC, row_key LIMIT 100"""


def _metrics_sql(source: str, by: str, binary: bool) -> str:
    """Per class tallies by plain conditional counts, then means."""
    pick = (lambda c: f"arg_max({c}, cls)") if binary else (lambda c: f"avg({c})")
    return f"""{source}, c AS (SELECT DISTINCT CAST(truth AS VARCHAR) AS cls FROM t UNION SELECT CAST(prediction AS VARCHAR) FROM t),
        k AS (SELECT {by} cls, count(*) FILTER (CAST(truth AS VARCHAR) = cls AND CAST(prediction AS VARCHAR) = cls) AS tp,
            count(*) FILTER (CAST(truth AS VARCHAR) = cls) AS sup, count(*) FILTER (CAST(prediction AS VARCHAR) = cls) AS pre
            FROM t, c GROUP BY ALL),
        s AS (SELECT *, CASE WHEN pre > 0 THEN tp / pre ELSE 0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS r,
            CASE WHEN sup + pre > 0 THEN 2 * tp / (sup + pre) ELSE 0 END AS f FROM k WHERE sup + pre > 0)
        SELECT {by} round(sum(tp) / sum(sup), 4) AS accuracy, round({pick('f')}, 4) AS f1,
            round(sum(f * sup) / sum(sup), 4) AS f1_weighted, round({pick('p')}, 4) AS "precision", round({pick('r')}, 4) AS recall,
            round(sum(p * sup) / sum(sup), 4) AS precision_weighted, round(sum(r * sup) / sum(sup), 4) AS recall_weighted
        FROM s GROUP BY ALL"""


def _split_sql(share: float) -> str:
    return f"""{_J}, r AS (SELECT row_key, truth, row_number() OVER (PARTITION BY truth ORDER BY {_draw('row_key', '42')}, row_key)
        AS place, count(*) OVER (PARTITION BY truth) AS n FROM t)
        SELECT row_key, truth, place <= ceil(round(n * {share}, 9)) AS is_test FROM r"""


def _coreset_sql(picks: int = 5) -> str:
    """The greedy picks one after the other, each against all centres so far."""
    steps = [
        f"""u AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding,
            lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
        c0 AS MATERIALIZED (SELECT vec_id, v FROM u ORDER BY {_draw('vec_id', '42')}, vec_id LIMIT 10),
        g0 AS MATERIALIZED (SELECT u.vec_id, u.v, min(list_distance(u.v, c0.v)) AS gap FROM u, c0
            WHERE u.vec_id NOT IN (SELECT vec_id FROM c0) GROUP BY ALL)"""
    ]
    for i in range(1, picks + 1):
        steps.append(f"p{i} AS MATERIALIZED (SELECT vec_id, v, gap FROM g{i - 1} ORDER BY gap DESC, vec_id LIMIT 1)")
        steps.append(
            f"""g{i} AS MATERIALIZED (SELECT g.vec_id, g.v, least(g.gap, list_distance(g.v, p{i}.v)) AS gap
            FROM g{i - 1} g, p{i} WHERE g.vec_id <> p{i}.vec_id)"""
        )
    rows = " UNION ALL ".join(f"SELECT {i} AS pick, vec_id, round(gap, 5) AS distance FROM p{i}" for i in range(1, picks + 1))
    return f"WITH {', '.join(steps)} {rows}"


_C = f"WITH t AS MATERIALIZED ({CANDIDATES.sql})"
_CLASS_SCORE = "coalesce(f1, 0) * 0.6 + coalesce(accuracy, 0) * 0.4"
_NAMES = """CASE model_type WHEN 'logistic_regression' THEN 'Logistic Regression' WHEN 'random_forest' THEN 'Random Forest'
    WHEN 'xgboost' THEN 'XGBoost' WHEN 'svm' THEN 'SVM' WHEN 'mlp' THEN 'Neural Net (MLP)' ELSE model_type END
    || CASE preset WHEN 'tuned' THEN ' (Tuned)' WHEN 'grid_search' THEN ' (Grid Search)' ELSE '' END"""
_SCORED = f"""WITH t AS ({SCORED.sql}), r AS (SELECT *, CASE WHEN probability >= 0.5 THEN 'yes' ELSE 'no' END AS prediction,
    CASE WHEN probability >= 0.6 THEN 'HIGH' WHEN probability >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM t)"""
_CAP = "upper(substr({x}, 1, 1)) || lower(substr({x}, 2))"

SQL = {
    "al_numeric_prep": f"""{_L}, m AS (SELECT quantile_cont(l_extendedprice, 0.5)::DOUBLE AS a, quantile_cont(l_suppkey, 0.5)::DOUBLE AS b
        FROM t), f AS (SELECT l_orderkey, l_linenumber, coalesce(l_extendedprice, a) AS p, coalesce(l_suppkey::DOUBLE, b) AS q
        FROM t, m), s AS (SELECT avg(p) AS pm, stddev_pop(p) AS ps, avg(q) AS qm, stddev_pop(q) AS qs FROM f)
        SELECT l_orderkey, l_linenumber, round((p - pm) / ps, 5) AS l_extendedprice, round((q - qm) / qs, 5) AS l_suppkey
        FROM f, s""",
    "al_onehot": _onehot("'missing'"),
    "al_onehot_frequent": _onehot(
        "(SELECT l_returnflag FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    ),
    "al_classes": f"{_L} SELECT DISTINCT l_returnflag AS label FROM t WHERE l_returnflag IS NOT NULL",
    "al_classes_too_many": "SELECT CASE WHEN count(DISTINCT user_id) <= 30 THEN count(DISTINCT user_id) ELSE 0 END AS n FROM events",
    "al_label_encode": """SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS label_code
        FROM part""",
    "al_initial": f"SELECT doc_id, lang FROM documents ORDER BY {_draw('doc_id', '42')}, doc_id LIMIT 50",
    "al_pool": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "al_random": f"""SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        ORDER BY {_draw('doc_id', 'round 3')}, doc_id LIMIT 30""",
    "al_least_confidence": _uncertain_sql("(1 - greatest(a, b, c))"),
    "al_margin": _uncertain_sql("(1 - (greatest(a, b, c) - (a + b + c - greatest(a, b, c) - least(a, b, c))))").replace(
        "a + b + c - greatest(a, b, c) - least(a, b, c)", "list_sort([a, b, c])[2]"
    ),
    "al_entropy": _uncertain_sql("(-(a * ln(a + 1e-10) + b * ln(b + 1e-10) + c * ln(c + 1e-10)))"),
    "al_vote_entropy": f"""WITH t AS ({VOTES.sql}), n AS (SELECT row_key, vote, count(*) / 4 AS p FROM t GROUP BY ALL)
        SELECT row_key, round(-sum(p * ln(p)), 6) AS score FROM n GROUP BY 1""",
    "al_coreset": _coreset_sql(),
    "al_folds": f"""SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {_draw('doc_id', '42')}, doc_id) - 1)
        % 5 AS INTEGER) AS fold FROM labels""",
    "al_confusion": f"""{_J} SELECT truth, count(*) FILTER (prediction = 'F') AS "pred_F", count(*) FILTER (prediction = 'O')
        AS "pred_O", count(*) FILTER (prediction = 'P') AS "pred_P" FROM t GROUP BY 1""",
    "al_rounds": f"""WITH t AS ({ROUNDS.sql}) SELECT a.*, b.accuracy AS previous_accuracy,
        round(a.accuracy - b.accuracy, 6) AS accuracy_delta FROM t a LEFT JOIN t b ON a.session_id = b.session_id
        AND a.round = b.round + 1""",
    "al_export": """SELECT doc_id, lang, source, n_chars, quality AS assigned_label FROM documents JOIN labels USING (doc_id)""",
    "al_batch_score": f"""{_SCORED} SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN {_CAP.format(x="split_part(trim(region), '-', 1)")}
        || '-West' WHEN 1 THEN {_CAP.format(x='region')} ELSE 'North ' || {_CAP.format(x="split_part(region, ' ', 2)")} END AS region,
        lower(trim(plan)) AS plan, round(probability, 3) AS probability, prediction, risk_level FROM r""",
    "al_batch_summary": f"""{_SCORED} SELECT count(*) AS "rows", count(*) FILTER (prediction = 'yes') AS at_risk,
        round(count(*) FILTER (prediction = 'yes') * 100.0 / count(*), 1)::DOUBLE AS at_risk_pct FROM r""",
    "al_riskiest": f"""{_SCORED} SELECT c_custkey, round(probability, 3) AS probability, risk_level FROM r
        ORDER BY round(probability, 3) DESC, c_custkey LIMIT 10""",
    "bm_source": """SELECT doc_id, lang, n_chars, quality AS target FROM documents JOIN labels USING (doc_id)
        WHERE doc_id % 3 <> 0 AND quality IS NOT NULL""",
    "bm_holdout": _split_sql(0.2),
    "bm_holdout_90": _split_sql(0.1),
    "bm_kfold": f"""{_J}, r AS (SELECT row_key, truth, CAST((row_number() OVER (PARTITION BY truth ORDER BY
        {_draw('row_key', '42')}, row_key) - 1) % 10 AS INTEGER) AS fold FROM t) SELECT truth, fold, count(*) AS n,
        CAST(sum(row_key) AS BIGINT) AS keys FROM r GROUP BY ALL""",
    "bm_kfold_plain": f"""{_J}, r AS (SELECT row_key, CAST((row_number() OVER (ORDER BY {_draw('row_key', '42')}, row_key) - 1) % 5
        AS INTEGER) AS fold FROM t) SELECT fold, count(*) AS n, CAST(sum(row_key) AS BIGINT) AS keys FROM r GROUP BY ALL""",
    "bm_class_metrics": _metrics_sql(_J, "", False),
    "bm_class_metrics_binary": _metrics_sql(f"WITH t AS MATERIALIZED ({TWO.sql})", "", True),
    "bm_auc": f"""{_J}, r AS (SELECT positive, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rnk
        FROM t), n AS (SELECT count(*) FILTER (positive = 1) AS p, count(*) FILTER (positive = 0) AS q FROM t)
        SELECT round((sum(rnk) - p * (p + 1) / 2) / (p * q), 4) AS roc_auc FROM r, n WHERE positive = 1 GROUP BY p, q""",
    "bm_reg_metrics": f"""{_J}, m AS (SELECT avg(y) AS a FROM t) SELECT round(1 - sum((y - estimate) ** 2) / sum((y - a) ** 2), 4) AS r2,
        round(avg(abs(y - estimate)), 4) AS mae, round(sqrt(avg((y - estimate) ** 2)), 4) AS rmse,
        round(avg(abs((y - estimate) / y)) FILTER (y <> 0) * 100, 2) AS mape FROM t, m""",
    "bm_fold_metrics": _metrics_sql(_J, "fold,", False),
    "bm_cv_two_class": f"""WITH t AS ({TWO_FOLDS.sql}), k AS (SELECT unnest(['no', 'yes']) AS c), n AS (
        SELECT fold, c, count(*) FILTER (truth = c AND prediction = c) AS tp, count(*) FILTER (truth = c) AS s, count(*) FILTER (prediction = c) AS p
        FROM t, k GROUP BY ALL), per AS (
        SELECT fold, sum(tp) / sum(s) AS accuracy, avg(2.0 * tp / (s + p)) AS f1, avg(tp / p) AS precision, avg(tp / s) AS recall FROM n GROUP BY fold)
        SELECT {", ".join(f"round(avg({m}), 4) AS {m}, round(stddev_pop({m}), 4) AS {m}_std" for m in ("accuracy", "f1", "precision", "recall"))} FROM per""",
    "bm_cv_summary": f"""WITH t AS ({FOLDS.sql}) SELECT candidate_id, round(avg(accuracy), 4) AS accuracy, round(avg(f1), 4) AS f1,
        round(stddev_pop(accuracy), 4) AS accuracy_std, round(stddev_pop(f1), 4) AS f1_std FROM t GROUP BY 1""",
    "bm_confusion": f"{_J} SELECT fold, truth, prediction, count(*) AS n FROM t GROUP BY ALL",
    "bm_winner": f"""{_C}, r AS (SELECT job, candidate_id, {_CLASS_SCORE} AS score, row_number() OVER (PARTITION BY job
        ORDER BY {_CLASS_SCORE} DESC, candidate_no) AS place FROM t WHERE status = 'complete')
        SELECT job, candidate_id AS winner, score FROM r WHERE place = 1""",
    "bm_winner_regression": f"""{_C}, r AS (SELECT job, candidate_id, coalesce(r2, -999.0) AS score, row_number() OVER
        (PARTITION BY job ORDER BY coalesce(r2, -999.0) DESC, candidate_no) AS place FROM t WHERE status = 'complete')
        SELECT job, candidate_id AS winner, score::DOUBLE AS score FROM r WHERE place = 1""",
    "bm_leaderboard": f"""{_C}, r AS (SELECT *, rank() OVER (ORDER BY {_CLASS_SCORE} DESC) AS place, row_number() OVER
        (ORDER BY {_CLASS_SCORE} DESC, candidate_no) AS k FROM t WHERE status = 'complete')
        SELECT place, candidate_id, label AS candidate_label, model_type, preset, accuracy, f1,
        CASE WHEN k = 1 THEN 'yes' ELSE '' END AS is_winner FROM r""",
    "bm_labels": f"""{_C}, n AS (SELECT candidate_no, label, model_type, preset, {_NAMES} AS base FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY base, trim(label) = '' ORDER BY candidate_no) AS k FROM n)
        SELECT candidate_no, CASE WHEN trim(label) <> '' THEN trim(label) WHEN k = 1 THEN base ELSE base || ' #' || k END AS label,
        model_type, preset FROM r""",
}

_LABELLED = "SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1"


def _candidates(model: str, rest: str) -> str:
    presets = ", ".join(f"({i}, '{model}_{p}')" for i, p in enumerate(models.PRESETS))
    return f"SELECT candidate_no, candidate_id, 'complete' AS status, {rest} FROM (VALUES {presets}) AS c(candidate_no, candidate_id)"


for _m in models.MODELS:
    _told = f"{'false' if _m == 'mlp' else 'true'} AS has_importances, true AS scores_in_bounds, true AS better_than_chance"
    SQL[f"bm_grid_{_m}"] = _candidates(_m, f"(SELECT sum(ceil(round(n * 0.2, 9)))::BIGINT FROM ({_LABELLED})) AS judged_rows, {_told}")
    SQL[f"bm_cross_validated_{_m}"] = _candidates(_m, f"(SELECT sum(n)::BIGINT FROM ({_LABELLED})) AS judged_rows, {_told}")
for _m in VALUE_MODELS:
    SQL[f"bm_regression_{_m}"] = _candidates(_m, "true AS r2_in_bounds, true AS rmse_covers_mae")
