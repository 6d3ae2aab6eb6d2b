"""Screening, evaluation and training-set queries that SQL can check."""

from pyspark.sql import functions as F

from visitloom.config import FIRST_YEAR, TARGETS
from visitloom.functions import scalar as fn
from visitloom.functions.scalar import rounded
from visitloom.operators import evaluate, folds, screen, training
from visitloom.plans.aggregates import _FT, SPEARMAN
from visitloom.plans.frames import scored, scores, stored_proteins
from visitloom.plans.registry import query
from visitloom.plans.windows import FOLD_SQL, IMPORTANCE, SWEEP, importance
from visitloom.session import materialize
from visitloom.sources import clinic

V, S = ("visits",), ("scores",)

_MOM = """, n AS (SELECT count(DISTINCT visit_id) AS n FROM proteins),
   mo AS (SELECT UniProt AS feature, n, sum(NPX) / n AS mean, sqrt(sum(NPX*NPX) / n - (sum(NPX)/n)*(sum(NPX)/n)) AS std
     FROM proteins, n GROUP BY UniProt, n)"""


@query(
    "M01_standardize",
    ("proteins",),
    _MOM
    + """ SELECT visit_id, feature, round((NPX - mean) / std, 6) AS z, round(-mean / std, 6) AS zero_value
       FROM proteins JOIN mo ON feature = UniProt""",
)
def _(spark, sf):
    f = stored_proteins(spark, sf)
    z = screen.standardize(f, screen.feature_moments(f))
    return z.select("visit_id", "feature", rounded("z").alias("z"), rounded("zero_value").alias("zero_value"))


# Coarse grid of Yeo-Johnson lambdas.
LAMBDAS = [-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0]
_YJ = "CASE WHEN abs(l) < 1e-9 THEN ln(1 + x) ELSE (pow(x + 1, l) - 1) / l END"


@query(
    "M03_yeo_johnson_fixed_lambda",
    ("proteins",),
    _MOM
    + """, s AS (SELECT visit_id, feature, NPX / std AS x FROM proteins JOIN mo ON feature = UniProt)
       SELECT visit_id, feature, round(ln(1 + x), 6) AS yj_0, round((pow(x + 1, 0.5) - 1) / 0.5, 6) AS yj_half,
         round(-ln(1 + x), 6) AS yj_neg_2 FROM s""",
)
def _(spark, sf):
    f = stored_proteins(spark, sf)
    s = f.join(F.broadcast(screen.feature_moments(f)), "feature").withColumn("x", F.col("value") / F.col("std"))
    return s.select(
        "visit_id",
        "feature",
        rounded(fn.yeo_johnson("x", F.lit(0.0))).alias("yj_0"),
        rounded(fn.yeo_johnson("x", F.lit(0.5))).alias("yj_half"),
        rounded(fn.yeo_johnson(-F.col("x"), F.lit(2.0))).alias("yj_neg_2"),
    )


@query(
    "M03_yeo_johnson_lambda",
    ("proteins",),
    _MOM
    + f""", s AS (SELECT feature, n, NPX / std AS x FROM proteins JOIN mo ON feature = UniProt),
       g AS (SELECT feature, n, l, sum({_YJ}) AS sy, sum(({_YJ}) * ({_YJ})) AS syy, sum(ln(1 + x)) AS slog
         FROM s, (SELECT unnest({LAMBDAS})::double AS l) GROUP BY feature, n, l),
       ll AS (SELECT feature, l, -n / 2.0 * ln(syy / n - (sy / n) * (sy / n)) + (l - 1) * slog AS v FROM g),
       k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v DESC, l) AS rn FROM ll)
       SELECT feature, l AS lambda, round(v, 3) AS log_likelihood FROM k WHERE rn = 1""",
)
def _(spark, sf):
    fit = screen.yeo_johnson_fit(stored_proteins(spark, sf), LAMBDAS)
    return fit.withColumn("log_likelihood", F.round("log_likelihood", 3))


@query("M03_yeo_johnson_transform")
def _(spark, sf):
    f = stored_proteins(spark, sf)
    moved = screen.yeo_johnson_apply(f, screen.yeo_johnson_refined(f, LAMBDAS))
    return moved.select("visit_id", "feature", rounded("z").alias("z"), rounded("zero_value").alias("zero_value"))


def with_squares(f):
    """Features and their squares, a frame with strongly related columns."""
    square = F.struct(F.concat("feature", F.lit("^2")).alias("feature"), (F.col("value") * F.col("value")).alias("value"))
    return f.select("visit_id", F.inline(F.array(F.struct("feature", "value"), square)))


@query(
    "M04_high_correlation_pairs",
    ("proteins",),
    SPEARMAN.replace("names AS (SELECT DISTINCT UniProt AS feature FROM proteins)",
        """both_f AS (SELECT visit_id, UniProt, NPX FROM proteins UNION ALL SELECT visit_id, UniProt || '^2', NPX*NPX FROM proteins),
        names AS (SELECT DISTINCT UniProt AS feature FROM both_f)""").replace("LEFT JOIN proteins p", "LEFT JOIN both_f p")
    + " SELECT feature_a, feature_b, round(r, 6) AS r FROM c WHERE r >= 0.75 OR r < -0.75",
)
def _(spark, sf):
    pairs = screen.high_pairs(screen.spearman_matrix(with_squares(stored_proteins(spark, sf))))
    return pairs.withColumn("r", rounded("r"))


@query("M05_prune_correlated")
def _(spark, sf):
    m = screen.spearman_matrix(with_squares(stored_proteins(spark, sf)))
    kept = screen.prune_correlated(m)
    return spark.createDataFrame([(k,) for k in kept], "feature string")


@query(
    "M06_importance_above_mean",
    ("scores", "feats"),
    _FT.format(where="")
    + IMPORTANCE
    + " SELECT feature, round(importance, 6) AS importance FROM imp WHERE importance >= (SELECT avg(importance) FROM imp)",
)
def _(spark, sf):
    imp = importance(spark, sf).withColumn("target", F.lit("updrs_1"))
    kept = screen.above_mean(imp, ["target"])
    return kept.select("feature", rounded("importance").alias("importance"))


@query(
    "M17_threshold_sweep",
    ("scored",),
    SWEEP
    + """ SELECT target, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sweep""",
)
def _(spark, sf):
    sweep = evaluate.threshold_sweep(scored(spark, sf), ["target"])
    return sweep.select("target", *[rounded(c).alias(c) for c in ("threshold", "accuracy", "precision", "recall", "f1")])


@query(
    "M19_linear_contributions",
    ("scores", "feats"),
    _FT.format(where="")
    + """, mean AS (SELECT feature, sum(value) / (SELECT count(DISTINCT visit_id) FROM feats) AS m FROM feats GROUP BY feature),
       c AS (SELECT visit_id, feature, r * (value - m) AS contrib FROM feats JOIN mean USING (feature) JOIN r USING (feature)
         WHERE target = 'updrs_1'
         UNION ALL SELECT v.visit_id, w.feature, r * (0 - m) FROM (SELECT DISTINCT visit_id FROM feats) v
         CROSS JOIN mean w JOIN r ON r.feature = w.feature AND target = 'updrs_1'
         WHERE NOT EXISTS (SELECT 1 FROM feats f WHERE f.visit_id = v.visit_id AND f.feature = w.feature)),
       k AS (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY round(contrib, 3) DESC, feature) AS rn FROM c)
       SELECT visit_id, feature, round(contrib, 3) AS contribution, cast(rn AS int) AS place FROM k WHERE rn <= 10""",
)
def _(spark, sf):
    from visitloom.operators.contributions import linear_contributions

    feats = materialize(clinic.features(spark, sf), "features")
    weights = screen.target_correlations(feats, clinic.visits(spark, sf), ["updrs_1"])
    weights = weights.select("feature", F.col("r").alias("weight"))
    return linear_contributions(feats, weights, top=10, places=3)


_HARD = ", h AS (SELECT target, label, cast(p >= 0.5 AS int) AS pred FROM scored)"


def _hard(spark, sf):
    return scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))


@query(
    "M20a_hard_auc",
    ("scored",),
    _HARD
    + """ SELECT target, round((count(*) FILTER (label = 1 AND pred = 1) / count(*) FILTER (label = 1)
         + count(*) FILTER (label = 0 AND pred = 0) / count(*) FILTER (label = 0)) / 2, 6) AS auc FROM h GROUP BY target""",
)
def _(spark, sf):
    return evaluate.hard_auc(_hard(spark, sf), ["target"]).withColumn("auc", rounded("auc"))


@query(
    "M20b_score_auc",
    ("scored",),
    """, t AS (SELECT target, label, round(p, 2) AS p FROM scored),
       k AS (SELECT target, label, rank() OVER (PARTITION BY target ORDER BY p)
         + (count(*) OVER (PARTITION BY target, p) - 1) / 2.0 AS rk FROM t)
       SELECT target, round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
         / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM k GROUP BY target""",
)
def _(spark, sf):
    # two places, so that scores tie
    s = scored(spark, sf).withColumn("p", F.round("p", 2))
    return evaluate.score_auc(s, ["target"]).withColumn("auc", rounded("auc"))


@query(
    "M20c_classification_metrics",
    ("scored",),
    _HARD
    + """, c AS (SELECT target, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
         count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 1 AND pred = 0) AS fn FROM h GROUP BY target)
       SELECT target, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision,
         round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
)
def _(spark, sf):
    m = evaluate.classification_metrics(_hard(spark, sf), ["target"])
    return m.select("target", *[rounded(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(
    "M20c_class_report",
    ("scored",),
    _HARD
    + """ SELECT target, k AS label, round(count(*) FILTER (label = k AND pred = k) / nullif(count(*) FILTER (pred = k), 0), 6) AS precision,
         round(count(*) FILTER (label = k AND pred = k) / nullif(count(*) FILTER (label = k), 0), 6) AS recall,
         round(2 * count(*) FILTER (label = k AND pred = k) / nullif(count(*) FILTER (pred = k) + count(*) FILTER (label = k), 0), 6) AS f1,
         count(*) FILTER (label = k) AS support
       FROM h, (VALUES (0), (1)) t(k) GROUP BY target, k""",
)
def _(spark, sf):
    r = evaluate.class_report(_hard(spark, sf), ["target"])
    return r.select("target", "label", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")], "support")


_REG = """, k AS (SELECT target, cast(score AS double) AS t, 20.0::double
     * (cast(concat('0x', substr(md5(concat(target, ':', visit_id)),1,7)) AS bigint)/268435455.0) AS q
     FROM scores WHERE score IS NOT NULL)"""


def _regression(spark, sf):
    s = scores(spark, sf).where("score is not null")
    p = F.lit(20.0) * fn.hash_score(F.concat("target", F.lit(":"), "visit_id"))
    return s.withColumn("prediction", p)


@query(
    "M20d_smape",
    S,
    _REG
    + """ SELECT target, round(avg(abs(q - t) / nullif((abs(t) + abs(q)) / 2, 0)) * 100, 2) AS smape_pct,
       round(avg(abs(q - t) / nullif((abs(t) + abs(q)) / 2, 0)), 6) AS smape FROM k GROUP BY target""",
)
def _(spark, sf):
    m = evaluate.regression_metrics(_regression(spark, sf), ["target"], "score", "prediction")
    return m.select("target", "smape_pct", rounded("smape").alias("smape"))


@query(
    "M20e_mse_r2",
    S,
    _REG
    + """ SELECT target, round(avg((q - t) * (q - t)), 6) AS mse,
       round(1 - sum((q - t) * (q - t)) / (sum(t * t) - sum(t) * sum(t) / count(*)), 6) AS r2 FROM k GROUP BY target""",
)
def _(spark, sf):
    m = evaluate.regression_metrics(_regression(spark, sf), ["target"], "score", "prediction")
    return m.select("target", rounded("mse").alias("mse"), rounded("r2").alias("r2"))


@query(
    "M22_residuals_by_month",
    S,
    _REG.replace("SELECT target, cast", "SELECT target, visit_month, cast")
    + """ SELECT target, visit_month, count(*) AS n, round(avg(t - q), 6) AS mean_residual, round(min(t - q), 6) AS min_residual,
       round(max(t - q), 6) AS max_residual, round(stddev_pop(t - q), 6) AS std_residual FROM k GROUP BY target, visit_month""",
)
def _(spark, sf):
    r = evaluate.residual_stats(_regression(spark, sf), ["target", "visit_month"], "score", "prediction")
    return r.select(
        "target", "visit_month", "n",
        *[rounded(c).alias(c) for c in ("mean_residual", "min_residual", "max_residual", "std_residual")],
    )


@query(
    "M24_hash_split",
    V,
    """SELECT visit_id, cast(concat('0x', substr(md5(concat('42:', visit_id)),1,7)) AS bigint) / 268435456.0 < 0.8 AS is_train FROM visits""",
)
def _(spark, sf):
    return folds.hash_split(clinic.visits(spark, sf), "visit_id").select("visit_id", "is_train")


@query(
    "M25_output_selection",
    ("scored",),
    """SELECT visit_id, target, CASE WHEN 1 - p >= p THEN 'mild' ELSE 'severe' END AS predicted_label,
         round(greatest(1 - p, p), 6) AS probability, 'mild,severe' AS labels FROM scored""",
)
def _(spark, sf):
    s = scored(spark, sf).withColumn("ps", F.array(1 - F.col("p"), F.col("p")))
    w = evaluate.winner(s, "ps", ["mild", "severe"])
    return w.select("visit_id", "target", "predicted_label", rounded("probability").alias("probability"), "labels")


@query(
    "M26_class_weight",
    ("scored",),
    """SELECT target, round(count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0), 6) AS pos_weight
       FROM scored GROUP BY target""",
)
def _(spark, sf):
    return evaluate.class_weights(scored(spark, sf), ["target"]).withColumn("pos_weight", rounded("pos_weight"))


_TOT = """, tot AS (SELECT visit_id, cast(sum(cast(value AS decimal(18,2))) AS double) AS num_prot_pep,
     coalesce(cast(sum(CASE WHEN kind = 'protein' THEN cast(value AS decimal(18,2)) END) AS double), 0.0) AS num_prot,
     coalesce(cast(sum(CASE WHEN kind = 'peptide' THEN cast(value AS decimal(18,2)) END) AS double), 0.0) AS num_pept
     FROM feats GROUP BY visit_id)"""
_SEV = """CASE WHEN score <= CASE target WHEN 'updrs_1' THEN 10 WHEN 'updrs_2' THEN 12 WHEN 'updrs_3' THEN 32 ELSE 4 END THEN 'mild'
     WHEN score <= CASE target WHEN 'updrs_1' THEN 21 WHEN 'updrs_2' THEN 29 WHEN 'updrs_3' THEN 58 ELSE 12 END THEN 'moderate'
     ELSE 'severe' END"""


@query(
    "M28_training_set",
    ("scores", "feats"),
    _TOT
    + """, nr AS (SELECT count(*) AS n_all FROM tot),
       k AS (SELECT s.*, num_prot_pep, num_prot, num_pept, n_all FROM scores s JOIN tot USING (visit_id), nr WHERE score IS NOT NULL)"""
    + FOLD_SQL.format(src="k", rows="n_all")
    + f""" SELECT visit_id, patient_id, visit_month, target, score, {_SEV} AS cat, kfold, num_prot_pep, num_prot, num_pept FROM folded""",
)
def _(spark, sf):
    return training.training_index(clinic.visits(spark, sf), clinic.features(spark, sf))


@query(
    "M31_request_set",
    ("visits", "feats"),
    _TOT
    + """ SELECT visit_id, patient_id, visit_month, num_prot_pep, num_prot, num_pept, target
       FROM visits JOIN tot USING (visit_id), (VALUES ('updrs_1'), ('updrs_2'), ('updrs_3'), ('updrs_4')) t(target)""",
)
def _(spark, sf):
    return training.request_index(clinic.visits(spark, sf), clinic.features(spark, sf), TARGETS)


@query(
    "M28_training_values",
    ("visits", "feats"),
    """SELECT v.visit_id, f.feature, f.value FROM visits v JOIN feats f USING (visit_id) WHERE visit_month <= 12""",
)
def _(spark, sf):
    early = clinic.visits(spark, sf).where(F.col("visit_month") <= FIRST_YEAR).select("visit_id")
    feats = clinic.features(spark, sf, FIRST_YEAR)
    return feats.join(early, "visit_id", "left_semi").select("visit_id", "feature", "value")


