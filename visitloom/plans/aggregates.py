"""Aggregate queries."""

from pyspark.sql import functions as F

from visitloom.config import FIRST_YEAR, SCORED_TARGETS, TARGETS
from visitloom.functions import scalar as fn
from visitloom.functions.scalar import rounded
from visitloom.operators import cohort, folds, labels, ranking, screen, shape
from visitloom.plans.frames import scored, scores, stored_features, stored_proteins
from visitloom.plans.registry import query
from visitloom.sources import clinic

V, S = ("visits",), ("scores",)

# The protein contract of the sample tables.
PROTEIN_NAMES = [f"Brand#{i}" for i in range(1, 26)]

_CAT = """CASE WHEN score <= CASE target WHEN 'updrs_1' THEN 10 WHEN 'updrs_2' THEN 12
   WHEN 'updrs_3' THEN 32 ELSE 4 END THEN 0 ELSE 1 END"""
_LAB = f""", lab AS (SELECT *, {_CAT} AS cat FROM scores WHERE target <> 'updrs_4')"""


def _labelled(spark, sf):
    return labels.visit_labels(scores(spark, sf, SCORED_TARGETS))


@query(
    "A01_group_extremes",
    S,
    """SELECT patient_id, target, max(score) AS max_score, min(score) AS min_score,
       round(avg(cast(score AS double)), 6) AS mean_score, max(score) - min(score) AS score_range
       FROM scores GROUP BY patient_id, target""",
)
def _(spark, sf):
    r = cohort.score_range(scores(spark, sf))
    return r.withColumn("mean_score", rounded("mean_score"))


@query(
    "A02_feature_extremes",
    ("visits", "proteins"),
    """, f AS (SELECT * FROM proteins WHERE visit_month <= 24),
       n AS (SELECT patient_id, count(DISTINCT visit_id) AS nv FROM f GROUP BY patient_id),
       g AS (SELECT patient_id, UniProt AS feature, max(NPX) AS mx, min(NPX) AS mn, count(*) AS c FROM f GROUP BY ALL)
       SELECT patient_id, feature, CASE WHEN c = nv THEN mx ELSE greatest(mx, 0.0) END AS max_value,
         CASE WHEN c = nv THEN mn ELSE least(mn, 0.0) END AS min_value FROM g JOIN n USING (patient_id)""",
)
def _(spark, sf):
    p = clinic.proteins(spark, sf).where("visit_month <= 24")
    f = p.select("patient_id", "visit_id", F.col("UniProt").alias("feature"), F.col("NPX").alias("value"))
    return cohort.feature_range(f, p.select("patient_id", "visit_id").distinct())


@query(
    "A03_first_last",
    S,
    """SELECT patient_id, target, arg_min(score, visit_month) AS first_score, arg_max(score, visit_month) AS last_score,
       min(visit_month) AS first_month, max(visit_month) AS last_month
       FROM scores WHERE score IS NOT NULL GROUP BY patient_id, target""",
)
def _(spark, sf):
    return cohort.first_last(scores(spark, sf))


@query(
    "A04_visits_per_patient",
    V,
    """SELECT num_visits, count(*) AS n FROM (SELECT patient_id, count(DISTINCT visit_month) AS num_visits
       FROM visits GROUP BY patient_id) GROUP BY num_visits""",
)
def _(spark, sf):
    return cohort.value_counts(cohort.visits_per_patient(clinic.visits(spark, sf)), "num_visits")


@query(
    "A05_value_counts",
    V,
    "SELECT visit_month, count(*) AS n FROM visits GROUP BY visit_month ORDER BY visit_month",
)
def _(spark, sf):
    return cohort.value_counts(clinic.visits(spark, sf), "visit_month").orderBy("visit_month")


@query(
    "A06_value_counts_table",
    V,
    """, m AS (SELECT patient_id, max(CASE WHEN updrs_1 <= 10 THEN 0 ELSE 1 END) AS updrs_1,
           max(CASE WHEN updrs_2 <= 12 THEN 0 ELSE 1 END) AS updrs_2,
           max(CASE WHEN updrs_3 <= 32 THEN 0 ELSE 1 END) AS updrs_3 FROM visits GROUP BY patient_id),
       l AS (SELECT 'updrs_1' AS target, updrs_1 AS c FROM m UNION ALL SELECT 'updrs_2', updrs_2 FROM m
             UNION ALL SELECT 'updrs_3', updrs_3 FROM m)
       SELECT target, nullif(count(*) FILTER (c = 0), 0) AS "0", nullif(count(*) FILTER (c = 1), 0) AS "1"
       FROM l GROUP BY target""",
)
def _(spark, sf):
    v = clinic.visits(spark, sf)
    worst = v.groupBy("patient_id").agg(
        *[F.max(fn.binary_severity(t, t)).alias(t) for t in SCORED_TARGETS]
    )
    return cohort.value_counts_table(worst, list(SCORED_TARGETS), [0, 1])


@query(
    "A07_count_ratio",
    S,
    _LAB
    + """, p AS (SELECT patient_id, target, max(cat) AS max_cat, max(CASE WHEN visit_month <= 12 THEN cat END) AS early
         FROM lab GROUP BY patient_id, target)
       SELECT target, max_cat, round(count(*) FILTER (early = max_cat) / count(*), 6) AS ratio
       FROM p GROUP BY target, max_cat""",
)
def _(spark, sf):
    p = cohort.reached_maximum(_labelled(spark, sf))
    # both counts come from one aggregate, so the two series need no join
    share = F.try_divide(F.count_if("reached").cast("double"), F.count(F.lit(1)))
    return p.groupBy("target", "max_cat").agg(rounded(share).alias("ratio"))


@query(
    "A08_global_extremes",
    V,
    "SELECT "
    + ", ".join(f"max({t}) AS max_{t}, min({t}) AS min_{t}" for t in TARGETS)
    + " FROM visits",
)
def _(spark, sf):
    v = clinic.visits(spark, sf)
    return v.agg(*[f(t).alias(f"{n}_{t}") for t in TARGETS for n, f in (("max", F.max), ("min", F.min))])


@query(
    "A09_null_fraction",
    V,
    "SELECT "
    + ", ".join(f"round(avg(CASE WHEN {t} IS NULL THEN 1.0::double ELSE 0.0 END), 6) AS {t}" for t in (*TARGETS, "med"))
    + " FROM visits",
)
def _(spark, sf):
    v = clinic.visits(spark, sf)
    return v.agg(*[rounded(F.avg(F.col(t).isNull().cast("double"))).alias(t) for t in (*TARGETS, "med")])


@query(
    "A10_transitions",
    S,
    _LAB
    + """, e AS (SELECT patient_id, target, arg_min(cat, visit_month) AS a, arg_max(cat, visit_month) AS b
         FROM lab GROUP BY patient_id, target)
       SELECT target, round(100 * count(*) FILTER (a = 0 AND b = 1) / count(*), 6) AS pct_0_1,
         round(100 * count(*) FILTER (a = 0 AND b = 0) / count(*), 6) AS pct_0_0,
         round(100 * count(*) FILTER (a = 1 AND b = 1) / count(*), 6) AS pct_1_1 FROM e GROUP BY target""",
)
def _(spark, sf):
    return cohort.transitions(_labelled(spark, sf))


@query(
    "A11_maximum_in_first_year",
    S,
    _LAB
    + """, p AS (SELECT patient_id, target, max(cat) AS m, max(CASE WHEN visit_month <= 12 THEN cat END) AS e
         FROM lab GROUP BY patient_id, target)
       SELECT target, round(100 * count(*) FILTER (e = m) / count(e), 2) AS pct FROM p GROUP BY target""",
)
def _(spark, sf):
    p = cohort.reached_maximum(_labelled(spark, sf)).where("early_cat is not null")
    return p.groupBy("target").agg(
        F.round(100 * F.count_if("reached") / F.count(F.lit(1)), 2).alias("pct")
    )


def _pair_sql(cols: tuple[str, ...], source: str) -> str:
    out = []
    for a in cols:
        for b in cols:
            x, y = f"cast({a} AS double)", f"cast({b} AS double)"
            out.append(
                f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round((count(*)*sum({x}*{y}) - sum({x})*sum({y})) /
                (sqrt(count(*)*sum({x}*{x}) - sum({x})*sum({x})) * sqrt(count(*)*sum({y}*{y}) - sum({y})*sum({y}))), 6) AS r
                FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
            )
    return " UNION ALL ".join(out)


@query("A12_pearson_matrix", V, _pair_sql(TARGETS, "visits"))
def _(spark, sf):
    m = cohort.pearson_matrix(clinic.visits(spark, sf), list(TARGETS))
    return m.withColumn("r", rounded("r"))


_FT = """, n AS (SELECT s.target, count(*) AS n, sum(cast(score AS double)) AS sy, sum(cast(score*score AS double)) AS syy
          FROM scores s WHERE score IS NOT NULL AND target <> 'updrs_4' AND {where}
            visit_id IN (SELECT visit_id FROM feats) GROUP BY s.target),
        x AS (SELECT s.target, f.feature, sum(value) AS sx, sum(value*value) AS sxx, sum(value*score) AS sxy
          FROM scores s JOIN feats f USING (visit_id) WHERE score IS NOT NULL AND {where} target <> 'updrs_4'
          GROUP BY s.target, f.feature),
        r AS (SELECT target, feature, (n*sxy - sx*sy) / (sqrt(n*sxx - sx*sx) * sqrt(n*syy - sy*sy)) AS r
          FROM x JOIN n USING (target))"""


@query(
    "A13_feature_target_correlation",
    ("scores", "feats"),
    _FT.format(where="") + " SELECT target, feature, round(r, 6) AS r FROM r",
)
def _(spark, sf):
    r = screen.target_correlations(
        stored_features(spark, sf), clinic.visits(spark, sf), list(SCORED_TARGETS)
    )
    return r.withColumn("r", rounded("r"))


@query(
    "A13_feature_target_correlation_first_year",
    ("scores", "feats"),
    _FT.format(where="visit_month <= 12 AND") + " SELECT target, feature, round(r, 6) AS r FROM r",
)
def _(spark, sf):
    early = clinic.visits(spark, sf).where(F.col("visit_month") <= FIRST_YEAR)
    r = screen.target_correlations(stored_features(spark, sf), early, list(SCORED_TARGETS))
    return r.withColumn("r", rounded("r"))


SPEARMAN = """, names AS (SELECT DISTINCT UniProt AS feature FROM proteins),
       dense AS (SELECT v.visit_id, n.feature, coalesce(p.NPX, 0.0) AS x
         FROM (SELECT DISTINCT visit_id FROM proteins) v CROSS JOIN names n
         LEFT JOIN proteins p ON p.visit_id = v.visit_id AND p.UniProt = n.feature),
       k AS (SELECT visit_id, feature, rank() OVER (PARTITION BY feature ORDER BY x)
           + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM dense),
       c AS (SELECT a.feature AS feature_a, b.feature AS feature_b, corr(a.rk, b.rk) AS r
         FROM k a JOIN k b ON a.visit_id = b.visit_id AND a.feature < b.feature GROUP BY 1, 2)"""


@query(
    "A14_spearman_matrix",
    ("proteins",),
    SPEARMAN + " SELECT feature_a, feature_b, round(r, 6) AS r FROM c",
)
def _(spark, sf):
    m = screen.spearman_matrix(stored_proteins(spark, sf))
    return m.withColumn("r", rounded("r"))


@query(
    "A15_quantiles",
    S,
    """SELECT target, round(quantile_cont(score, 0.33), 6) AS q33, round(quantile_cont(score, 0.66), 6) AS q66
       FROM scores WHERE score IS NOT NULL GROUP BY target""",
)
def _(spark, sf):
    q = ranking.quantiles(scores(spark, sf), ["target"], "score", {"q33": 0.33, "q66": 0.66})
    return q.select("target", rounded("q33").alias("q33"), rounded("q66").alias("q66"))


@query(
    "A15_quantiles_continuous",
    ("proteins",),
    """SELECT UniProt AS feature, round(quantile_cont(NPX, 0.33), 6) AS q33, round(quantile_cont(NPX, 0.66), 6) AS q66
       FROM proteins GROUP BY UniProt""",
)
def _(spark, sf):
    q = ranking.quantiles(
        clinic.protein_features(spark, sf), ["feature"], "value", {"q33": 0.33, "q66": 0.66}
    )
    return q.select("feature", rounded("q33").alias("q33"), rounded("q66").alias("q66"))


@query(
    "A16_quantile_bins",
    S,
    """, r AS (SELECT patient_id, target, max(score) - min(score) AS score_range FROM scores GROUP BY 1, 2),
       e AS (SELECT target, quantile_cont(score_range, 1/3.0) AS e1, quantile_cont(score_range, 2/3.0) AS e2 FROM r GROUP BY target)
       SELECT patient_id, target, score_range, CASE WHEN score_range <= e1 THEN 'low' WHEN score_range <= e2 THEN 'medium'
         WHEN score_range IS NOT NULL THEN 'high' END AS level FROM r JOIN e USING (target)""",
)
def _(spark, sf):
    r = cohort.score_range(scores(spark, sf)).select("patient_id", "target", "score_range")
    return cohort.tertile_class(r, "score_range", ["target"])


@query(
    "A17_least_squares",
    S,
    """SELECT target, round(regr_slope(score, visit_month), 6) AS slope, round(regr_intercept(score, visit_month), 6) AS intercept
       FROM scores WHERE score IS NOT NULL GROUP BY target""",
)
def _(spark, sf):
    s = scores(spark, sf).where("score is not null")
    return s.groupBy("target").agg(
        rounded(F.regr_slope("score", "visit_month")).alias("slope"),
        rounded(F.regr_intercept("score", "visit_month")).alias("intercept"),
    )


@query(
    "A18_histogram",
    S,
    """, e AS (SELECT target, min(score) AS lo, max(score) AS hi FROM scores GROUP BY target)
       SELECT target, cast(greatest(0, ceil((score - lo) / cast(hi - lo AS double) * 20) - 1) AS int) AS bin, count(*) AS n
       FROM scores JOIN e USING (target) WHERE score IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    known = scores(spark, sf).where("score is not null")
    binned = folds.equal_width_bins(known, "score", ["target"], 20)
    return binned.groupBy("target", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "A19_value_set",
    V,
    """SELECT patient_id, array_to_string(list_sort(list(DISTINCT visit_month)), ',') AS months
       FROM visits GROUP BY patient_id""",
)
def _(spark, sf):
    # a patient's set of months is bounded by the calendar
    return clinic.visits(spark, sf).groupBy("patient_id").agg(
        F.array_join(F.sort_array(F.collect_set("visit_month")).cast("array<string>"), ",").alias("months")
    )


@query(
    "A20_pivot",
    ("proteins",),
    "SELECT visit_id, "
    + ", ".join(f"max(CASE WHEN UniProt = '{b}' THEN NPX END) AS \"{b}\"" for b in PROTEIN_NAMES)
    + " FROM proteins GROUP BY visit_id",
)
def _(spark, sf):
    return shape.pivot_unique(clinic.proteins(spark, sf), ["visit_id"], "UniProt", "NPX", PROTEIN_NAMES)


@query(
    "A21_melt",
    V,
    " UNION ALL ".join(f"SELECT visit_id, '{t}' AS target, {t} AS score FROM visits" for t in TARGETS),
)
def _(spark, sf):
    v = clinic.visits(spark, sf).select("visit_id", *TARGETS)
    return shape.melt(v, ["visit_id"], list(TARGETS), "target", "score")


@query(
    "A22_transpose",
    V,
    """, m AS (SELECT coalesce(med, 'Unknown') AS med, max(updrs_1) AS updrs_1, max(updrs_2) AS updrs_2 FROM visits GROUP BY 1)
       SELECT 'updrs_1' AS target, max(CASE med WHEN 'Off' THEN updrs_1 END) AS "Off",
         max(CASE med WHEN 'On' THEN updrs_1 END) AS "On", max(CASE med WHEN 'Unknown' THEN updrs_1 END) AS "Unknown" FROM m
       UNION ALL SELECT 'updrs_2', max(CASE med WHEN 'Off' THEN updrs_2 END),
         max(CASE med WHEN 'On' THEN updrs_2 END), max(CASE med WHEN 'Unknown' THEN updrs_2 END) FROM m""",
)
def _(spark, sf):
    m = clinic.visits(spark, sf).groupBy(F.coalesce("med", F.lit("Unknown")).alias("med")).agg(
        F.max("updrs_1").alias("updrs_1"), F.max("updrs_2").alias("updrs_2")
    )
    return shape.transpose(m, "med", ["updrs_1", "updrs_2"], ["Off", "On", "Unknown"], "target")


@query(
    "A23_mean_metric",
    ("scored",),
    """, f AS (SELECT target, label, p, cast(concat('0x', substr(md5(visit_id),1,7)) AS bigint) % 5 AS fold FROM scored),
       m AS (SELECT target, fold, avg(cast((p >= 0.5) = (label = 1) AS int)) AS acc FROM f GROUP BY 1, 2)
       SELECT target, count(*) AS n_folds, round(avg(acc), 6) AS mean_acc FROM m GROUP BY target""",
)
def _(spark, sf):
    fold = F.conv(F.substring(F.md5("visit_id"), 1, 7), 16, 10).cast("bigint") % 5
    right = ((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("int")
    per_fold = scored(spark, sf).groupBy("target", fold.alias("fold")).agg(F.avg(right).alias("acc"))
    return per_fold.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_folds"), rounded(F.avg("acc")).alias("mean_acc")
    )


@query(
    "A24_mean_statistic_by_class",
    ("scores", "feats"),
    _LAB
    + """, fut AS (SELECT *, max(cat) OVER (PARTITION BY patient_id, target) AS max_cat FROM lab),
       t AS (SELECT visit_id, cast(sum(CASE WHEN kind = 'protein' THEN cast(value AS decimal(18,2)) END) AS double) AS num_prot,
         count(*) FILTER (kind = 'protein' AND value > 0) AS gt0 FROM feats GROUP BY visit_id)
       SELECT target, max_cat, count(*) AS n, round(avg(num_prot), 2) AS mean_num_prot, round(avg(gt0), 6) AS mean_prot_gt_0
       FROM fut JOIN t USING (visit_id) WHERE visit_month <= 12 GROUP BY target, max_cat""",
)
def _(spark, sf):
    fut = labels.patient_labels(clinic.visits(spark, sf), SCORED_TARGETS)
    totals = shape.visit_totals(clinic.features(spark, sf))
    return fut.join(totals, "visit_id").groupBy("target", "max_cat").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("num_prot"), 2).alias("mean_num_prot"),
        rounded(F.avg("n_prot_gt_0")).alias("mean_prot_gt_0"),
    )


@query(
    "A25_class_share",
    S,
    _LAB
    + """, c AS (SELECT target, cat, count(*) AS n FROM lab WHERE visit_month <= 12 GROUP BY target, cat)
       SELECT target, cat, n, round(n / sum(n) OVER (PARTITION BY target), 6) AS share FROM c""",
)
def _(spark, sf):
    lab = _labelled(spark, sf).where(F.col("visit_month") <= FIRST_YEAR)
    counts = lab.groupBy("target", "cat").agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the class counts, a handful of rows per target
    total = F.sum("n").over(ranking.Window.partitionBy("target"))
    return counts.select("target", "cat", "n", rounded(F.col("n") / total).alias("share"))


@query(
    "A26_month_twelve_share",
    V,
    """SELECT round(count(*) FILTER (visit_month = 12) / count(DISTINCT patient_id), 6) AS share FROM visits""",
)
def _(spark, sf):
    v = clinic.visits(spark, sf)
    share = F.count_if(F.col("visit_month") == FIRST_YEAR) / F.countDistinct("patient_id")
    return v.agg(rounded(share).alias("share"))


@query(
    "A26_months_of_the_others",
    V,
    """SELECT visit_month, count(*) AS n FROM visits WHERE patient_id NOT IN
       (SELECT patient_id FROM visits WHERE visit_month = 12) GROUP BY visit_month""",
)
def _(spark, sf):
    has = F.max((F.col("visit_month") == FIRST_YEAR).cast("int")).over(labels.per_patient())
    others = clinic.visits(spark, sf).select("visit_month", has.alias("_has")).where("_has = 0")
    return cohort.value_counts(others, "visit_month")
