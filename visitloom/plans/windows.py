"""Window, sort, set and longitudinal queries."""

from pyspark.sql import functions as F

from visitloom.config import SCORED_TARGETS
from visitloom.functions import scalar as fn
from visitloom.functions.scalar import rounded
from visitloom.operators import cohort, folds, labels, longitudinal, ranking, screen
from visitloom.plans.aggregates import _FT, _LAB
from visitloom.plans.frames import scored, scores, stored_features
from visitloom.plans.registry import query
from visitloom.sources import clinic

V, S = ("visits",), ("scores",)

FOLD_SQL = """, n AS (SELECT target, count(*) AS n FROM {src} GROUP BY target),
   e AS (SELECT target, min(score) AS lo, max(score) AS hi FROM {src} GROUP BY target),
   b AS (SELECT s.*, CASE WHEN hi = lo THEN 0 ELSE greatest(0, ceil((score - lo) / cast(hi - lo AS double)
          * floor(1 + log2({rows}))) - 1) END AS bin FROM {src} s JOIN e USING (target) JOIN n USING (target)),
   folded AS (SELECT *, cast((row_number() OVER (PARTITION BY target ORDER BY bin, md5(concat('42:', visit_id))) - 1) % 5 AS int)
          AS kfold FROM b)"""


@query(
    "W01_stratified_folds",
    S,
    ", k AS (SELECT * FROM scores WHERE score IS NOT NULL)"
    + FOLD_SQL.format(src="k", rows="n.n")
    + " SELECT visit_id, target, kfold FROM folded",
)
def _(spark, sf):
    known = scores(spark, sf).where("score is not null")
    return folds.binned_folds(known).select("visit_id", "target", "kfold")


@query(
    "W02_equal_width_bins",
    S,
    """, e AS (SELECT target, min(score) AS lo, max(score) AS hi FROM scores GROUP BY target)
       SELECT visit_id, target, cast(greatest(0, ceil((score - lo) / cast(hi - lo AS double) * 12) - 1) AS int) AS bin
       FROM scores JOIN e USING (target) WHERE score IS NOT NULL""",
)
def _(spark, sf):
    known = scores(spark, sf).where("score is not null")
    return folds.equal_width_bins(known, "score", ["target"], 12).select("visit_id", "target", "bin")


@query(
    "W03_sturges_bins",
    S,
    """SELECT target, cast(floor(1 + log2(count(*))) AS int) AS n_bins FROM scores
       WHERE score IS NOT NULL GROUP BY target""",
)
def _(spark, sf):
    known = scores(spark, sf).where("score is not null")
    return known.groupBy("target").agg(folds.sturges(F.count(F.lit(1))).alias("n_bins"))


@query(
    "W04_change_from_first",
    S,
    """SELECT visit_id, target,
         score - max(CASE WHEN visit_month = 0 THEN score END) OVER (PARTITION BY patient_id, target) AS change
       FROM scores""",
)
def _(spark, sf):
    return longitudinal.change_from_first(scores(spark, sf)).select("visit_id", "target", "change")


def _edge_sql(direction):
    return f"""SELECT patient_id, visit_id, visit_month, updrs_1, med FROM (SELECT *, row_number() OVER
       (PARTITION BY patient_id ORDER BY visit_month {direction}) AS rn FROM visits) WHERE rn = 1"""


@query("W05_first_visit_row", V, _edge_sql(""))
def _(spark, sf):
    return longitudinal.edge_visit(
        clinic.visits(spark, sf), ["visit_id", "visit_month", "updrs_1", "med"]
    )


@query("W05_last_visit_row", V, _edge_sql("DESC"))
def _(spark, sf):
    return longitudinal.edge_visit(
        clinic.visits(spark, sf), ["visit_id", "visit_month", "updrs_1", "med"], last=True
    )


@query(
    "W06_partition_max",
    V,
    "SELECT visit_id, max(updrs_1) OVER (PARTITION BY patient_id) AS max_updrs_1 FROM visits",
)
def _(spark, sf):
    top = F.max("updrs_1").over(labels.per_patient())
    return clinic.visits(spark, sf).select("visit_id", top.alias("max_updrs_1"))


@query(
    "W07_row_index",
    V,
    """SELECT visit_id, row_number() OVER (ORDER BY patient_id, visit_month) - 1 AS row_index FROM visits""",
)
def _(spark, sf):
    v = clinic.visits(spark, sf).select("visit_id", "patient_id", "visit_month").withColumn("_one", F.lit(1))
    bucket = ranking.magnitude_bucket("patient_id", per_octave=4096)
    placed = ranking.running(v, [], ["patient_id", "visit_month"], {"_one": "row_index"}, bucket)
    return placed.select("visit_id", "row_index")


@query(
    "T01_multi_key_sort",
    V,
    "SELECT patient_id, visit_month, updrs_1 FROM visits ORDER BY patient_id, visit_month DESC",
)
def _(spark, sf):
    v = clinic.visits(spark, sf).select("patient_id", "visit_month", "updrs_1")
    return v.orderBy("patient_id", F.desc("visit_month"))


IMPORTANCE = ", imp AS (SELECT feature, abs(r) AS importance FROM r WHERE target = 'updrs_1')"


def importance(spark, sf):
    """A given importance: absolute correlation with the first score."""
    r = screen.target_correlations(stored_features(spark, sf), clinic.visits(spark, sf), ["updrs_1"])
    return r.select("feature", F.abs("r").alias("importance"))


@query(
    "T02_top_features",
    ("scores", "feats"),
    _FT.format(where="")
    + IMPORTANCE
    + " SELECT feature, round(importance, 6) AS importance FROM imp ORDER BY importance DESC, feature LIMIT 10",
)
def _(spark, sf):
    top = importance(spark, sf).orderBy(F.desc("importance"), "feature").limit(10)
    return top.withColumn("importance", rounded("importance"))


@query(
    "T03_ranked_correlations",
    ("scores", "feats"),
    _FT.format(where="")
    + """, k AS (SELECT target, feature, r, row_number() OVER (PARTITION BY target ORDER BY r DESC, feature) AS head,
           row_number() OVER (PARTITION BY target ORDER BY r, feature) AS tail FROM r)
        SELECT target, feature, round(r, 6) AS r, CASE WHEN head <= 10 THEN 'head' ELSE 'tail' END AS side
        FROM k WHERE head <= 10 OR tail <= 10""",
)
def _(spark, sf):
    r = screen.target_correlations(
        stored_features(spark, sf), clinic.visits(spark, sf), list(SCORED_TARGETS)
    )
    # one row per feature and target: the windows are as long as the contract
    w = ranking.Window.partitionBy("target")
    ranked = r.select(
        "*",
        F.row_number().over(w.orderBy(F.desc("r"), "feature")).alias("_head"),
        F.row_number().over(w.orderBy("r", "feature")).alias("_tail"),
    ).where("_head <= 10 or _tail <= 10")
    return ranked.select(
        "target", "feature", rounded("r").alias("r"),
        F.when(F.col("_head") <= 10, "head").otherwise("tail").alias("side"),
    )


_SWEEP = """, g AS (SELECT target, i, i * (1.0::double / 99) AS t FROM range(1, 99) r(i), (SELECT DISTINCT target FROM scored)),
   w AS (SELECT g.target, g.i, g.t, count(*) FILTER (label = 1 AND p >= t) AS tp, count(*) FILTER (label = 0 AND p >= t) AS fp,
     count(*) FILTER (label = 1 AND p < t) AS fn, count(*) FILTER (label = 0 AND p < t) AS tn
     FROM g JOIN scored USING (target) GROUP BY 1, 2, 3),
   m AS (SELECT target, t AS threshold, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / nullif(tp + fp, 0) AS precision,
     tp / nullif(tp + fn, 0) AS recall FROM w),
   sweep AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM m)"""
SWEEP = _SWEEP.replace(
    "i * (1.0::double / 99) AS t FROM range(1, 99)",
    "CASE WHEN i = 99 THEN 1.0::double ELSE i * (1.0::double / 99) END AS t FROM range(0, 100)",
)


@query(
    "T04_best_parameter",
    ("scored",),
    """, s AS (SELECT target, v, round(avg(cast((p >= v / 10.0::double) = (label = 1) AS int)), 4) AS acc
         FROM scored, range(1, 10) r(v) GROUP BY target, v)
       SELECT target, cast(min(v) AS int) AS best_value, acc FROM s WHERE acc = (SELECT max(acc) FROM s t WHERE t.target = s.target)
       GROUP BY target, acc""",
)
def _(spark, sf):
    # a sweep table: accuracy per value of one parameter, the call threshold in tenths
    right = lambda v: F.avg(((F.col("p") >= v / 10.0) == (F.col("label") == 1)).cast("int"))
    wide = scored(spark, sf).groupBy("target").agg(
        F.array(*[F.struct(F.lit(v).alias("val"), F.round(right(v), 4).alias("acc")) for v in range(1, 10)]).alias("_s")
    )
    sweep = wide.select("target", F.inline("_s"))
    return sweep.groupBy("target").agg(
        F.max_by("val", F.struct("acc", -F.col("val"))).alias("best_value"), F.max("acc").alias("acc")
    )


@query(
    "T05_best_threshold",
    ("scored",),
    SWEEP
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY f1 DESC, threshold) AS rn FROM sweep WHERE f1 IS NOT NULL)
        SELECT target, round(f1, 6) AS best_f1, round(threshold, 6) AS threshold FROM k WHERE rn = 1""",
)
def _(spark, sf):
    from visitloom.operators import evaluate

    best = evaluate.best_threshold(evaluate.threshold_sweep(scored(spark, sf), ["target"]), ["target"])
    return best.select("target", rounded("best_f1").alias("best_f1"), rounded("threshold").alias("threshold"))


@query(
    "U01_union_with_tag",
    V,
    " UNION ALL ".join(
        f"SELECT 'UPDRS {i}' AS updrs, updrs_{i} AS value, visit_month, patient_id FROM visits" for i in (1, 2, 3)
    ),
)
def _(spark, sf):
    v = clinic.visits(spark, sf)
    # the union of three projections of one table is one unpivot of it
    long = v.unpivot(["patient_id", "visit_month"], list(SCORED_TARGETS), "target", "value")
    tag = F.concat(F.lit("UPDRS "), F.substring("target", -1, 1))
    return long.select(tag.alias("updrs"), "value", "visit_month", "patient_id")


@query(
    "U02_append_over_patients",
    ("visits",),
    """SELECT patient_id, count(*) AS n_visits, max(updrs_1) AS max_updrs_1 FROM visits GROUP BY patient_id""",
)
def _(spark, sf):
    return clinic.visits(spark, sf).groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_visits"), F.max("updrs_1").alias("max_updrs_1")
    )


@query(
    "U03_patient_intersection",
    ("visits", "proteins"),
    """SELECT patient_id FROM visits WHERE updrs_4 IS NOT NULL INTERSECT SELECT patient_id FROM proteins WHERE NPX > 200000""",
)
def _(spark, sf):
    a = clinic.visits(spark, sf).where("updrs_4 is not null").select("patient_id")
    b = clinic.proteins(spark, sf).where("NPX > 200000").select("patient_id")
    return a.intersect(b)


@query(
    "U04_feature_difference",
    ("feats",),
    """SELECT feature FROM feats EXCEPT SELECT feature FROM feats WHERE contains(feature, '_')""",
)
def _(spark, sf):
    # names without the peptide mark: a difference on one column is a filter
    names = clinic.features(spark, sf).select("feature").where(~F.col("feature").contains("_"))
    return names.distinct()


_MONTHS = [0, 6, 12, 18, 24, 36]


@query(
    "TS01_score_by_month",
    S,
    "SELECT b.visit_id, b.target, "
    + ", ".join(f"max(CASE WHEN s.visit_month = {m} THEN s.score END) AS score_{m}" for m in _MONTHS)
    + """ FROM scores b JOIN scores s USING (patient_id, target) WHERE b.visit_month = 0 GROUP BY b.visit_id, b.target""",
)
def _(spark, sf):
    return longitudinal.score_by_month(scores(spark, sf), _MONTHS)


@query(
    "TS02_pair_deltas",
    ("scores", "proteins"),
    """, k AS (SELECT * FROM scores WHERE score IS NOT NULL AND visit_id IN (SELECT visit_id FROM proteins))
       , u AS (SELECT *, unnest(list({'m': visit_month, 's': score}) OVER (PARTITION BY patient_id, target)) AS o FROM k)
       SELECT visit_id, patient_id, visit_month, target, score, o.m - visit_month AS visit_month_diff,
         o.s - score AS score_diff FROM u WHERE o.m <> visit_month""",
)
def _(spark, sf):
    sampled = clinic.proteins(spark, sf).select("visit_id").distinct()
    s = scores(spark, sf).join(sampled, "visit_id", "left_semi")
    return longitudinal.pair_deltas(s)


_DELTA = """, sv AS (SELECT DISTINCT v.visit_id, v.patient_id, v.visit_month FROM visits v JOIN proteins p USING (visit_id)
         WHERE v.visit_month IN (0, 12, 18, 24)),
       names AS (SELECT DISTINCT sv.patient_id, UniProt AS feature FROM sv JOIN proteins USING (visit_id)),
       val AS (SELECT n.patient_id, n.feature, sv.visit_month, coalesce(p.NPX, 0.0) AS x FROM names n
         JOIN sv ON sv.patient_id = n.patient_id
         LEFT JOIN proteins p ON p.visit_id = sv.visit_id AND p.UniProt = n.feature),
       d AS (SELECT z.patient_id, z.feature, max(CASE WHEN o.visit_month = 12 THEN o.x - z.x END) AS d12,
         max(CASE WHEN o.visit_month = 18 THEN o.x - z.x END) AS d18, max(CASE WHEN o.visit_month = 24 THEN o.x - z.x END) AS d24
         FROM val z JOIN val o ON o.patient_id = z.patient_id AND o.feature = z.feature AND o.visit_month > 0
         WHERE z.visit_month = 0 GROUP BY z.patient_id, z.feature)"""


def _deltas(spark, sf):
    return longitudinal.feature_deltas(clinic.protein_features(spark, sf), clinic.visits(spark, sf))


@query(
    "TS03_feature_deltas",
    ("visits", "proteins"),
    _DELTA + " SELECT patient_id, feature, round(d12, 4) AS d12, round(d18, 4) AS d18, round(d24, 4) AS d24 FROM d",
)
def _(spark, sf):
    d = _deltas(spark, sf)
    return d.select("patient_id", "feature", *[F.round(c, 4).alias(c) for c in ("d12", "d18", "d24")])


@query(
    "TS04_delta_extremes",
    ("visits", "proteins"),
    _DELTA
    + """ SELECT patient_id, feature, round(greatest(d12, d18, d24), 4) AS max_diff, round(least(d12, d18, d24), 4) AS min_diff FROM d""",
)
def _(spark, sf):
    e = longitudinal.delta_extremes(_deltas(spark, sf))
    return e.select(
        "patient_id", "feature", F.round("max_diff", 4).alias("max_diff"), F.round("min_diff", 4).alias("min_diff")
    )


@query(
    "TS05_two_year_features",
    ("visits", "proteins"),
    _DELTA
    + """, f AS (SELECT * FROM proteins WHERE visit_month <= 24),
       n AS (SELECT patient_id, count(DISTINCT visit_id) AS nv FROM f GROUP BY patient_id),
       g AS (SELECT patient_id, UniProt AS feature, max(NPX) AS mx, min(NPX) AS mn, count(*) AS c FROM f GROUP BY ALL),
       raw AS (SELECT patient_id, feature, mx AS max_value, CASE WHEN c = nv THEN mn ELSE 0.0 END AS min_value FROM g JOIN n USING (patient_id))
       SELECT patient_id, feature, round(greatest(d12, d18, d24), 4) AS max_diff, round(least(d12, d18, d24), 4) AS min_diff,
         max_value, min_value FROM d JOIN raw USING (patient_id, feature)""",
)
def _(spark, sf):
    p = clinic.proteins(spark, sf, 24).where("visit_month <= 24")
    f = p.select("patient_id", "visit_id", F.col("UniProt").alias("feature"), F.col("NPX").alias("value"))
    raw = cohort.feature_range(f, p.select("patient_id", "visit_id").distinct())
    e = longitudinal.delta_extremes(_deltas(spark, sf)).select(
        "patient_id", "feature", F.round("max_diff", 4).alias("max_diff"), F.round("min_diff", 4).alias("min_diff")
    )
    return e.join(raw, ["patient_id", "feature"])


_RATE = """, e AS (SELECT patient_id, target, arg_min(score, visit_month) AS f, arg_max(score, visit_month) AS l,
         min(visit_month) AS fm, max(visit_month) AS lm FROM scores WHERE score IS NOT NULL GROUP BY 1, 2),
       rate AS (SELECT patient_id, target, f, l, (l - f) / cast(nullif(lm - fm, 0) AS double) AS avg_monthly_diff FROM e)"""


@query(
    "TS06_monthly_rate",
    S,
    _RATE + " SELECT patient_id, target, round(avg_monthly_diff, 6) AS avg_monthly_diff FROM rate",
)
def _(spark, sf):
    r = longitudinal.monthly_rate(scores(spark, sf))
    return r.select("patient_id", "target", rounded("avg_monthly_diff").alias("avg_monthly_diff"))


@query(
    "TS07_large_change_flags",
    S,
    _RATE
    + """, q AS (SELECT target, quantile_cont(avg_monthly_diff, 0.66) AS qr, quantile_cont(l, 0.66) AS ql FROM rate GROUP BY target)
       SELECT patient_id, target, CASE WHEN avg_monthly_diff <= qr THEN 0 ELSE 1 END AS large_diff,
         CASE WHEN l <= ql THEN 0 ELSE 1 END AS large_last_val FROM rate JOIN q USING (target)""",
)
def _(spark, sf):
    return longitudinal.large_change_flags(scores(spark, sf))


@query(
    "TS08_forecast_grid",
    S,
    """SELECT concat(visit_id, '_', target, '_plus_', cast(m AS varchar), '_months') AS prediction_id, 0 AS rating,
         visit_month AS group_key, m AS plus_months
       FROM scores, (VALUES (0), (6), (12), (24)) t(m) WHERE visit_month IN (0, 6)""",
)
def _(spark, sf):
    requests = scores(spark, sf).where("visit_month in (0, 6)").select(
        "visit_id", F.col("target").alias("updrs_test"), F.col("visit_month").alias("group_key")
    )
    return longitudinal.forecast_grid(requests)


@query(
    "TS09_future_label",
    S,
    _LAB
    + """, w AS (SELECT *, max(cat) OVER (PARTITION BY patient_id, target) AS max_cat FROM lab)
       SELECT visit_id, target, cat, max_cat FROM w WHERE visit_month <= 12""",
)
def _(spark, sf):
    out = labels.patient_labels(clinic.visits(spark, sf), SCORED_TARGETS)
    return out.select("visit_id", "target", "cat", "max_cat")


@query(
    "TS10_window_label",
    S,
    _LAB
    + """ SELECT visit_id, target, cat, max(cat) OVER (PARTITION BY patient_id, target) AS max_cat
       FROM lab WHERE visit_month <= 12""",
)
def _(spark, sf):
    out = labels.patient_labels(clinic.visits(spark, sf), SCORED_TARGETS, whole_history=False)
    return out.select("visit_id", "target", "cat", "max_cat")


@query(
    "TS11_month_zero_scores",
    V,
    """SELECT v.visit_id, b.updrs_1 AS updrs_1_0_month, b.updrs_2 AS updrs_2_0_month, b.updrs_3 AS updrs_3_0_month
       FROM visits v LEFT JOIN (SELECT * FROM visits WHERE visit_month = 0) b USING (patient_id)""",
)
def _(spark, sf):
    v = labels.attach_month_zero(clinic.visits(spark, sf), list(SCORED_TARGETS))
    return v.select("visit_id", *[f"{t}_0_month" for t in SCORED_TARGETS])


@query(
    "TS12_visit_counts_attached",
    V,
    """SELECT visit_id, count(*) OVER (PARTITION BY patient_id) AS num_visits,
         count(*) FILTER (visit_month <= 12) OVER (PARTITION BY patient_id) AS num_visits_12m FROM visits""",
)
def _(spark, sf):
    w = labels.per_patient()
    months = F.size(F.collect_set("visit_month").over(w)).cast("bigint")
    early = F.size(
        F.collect_set(F.when(F.col("visit_month") <= 12, F.col("visit_month"))).over(w)
    ).cast("bigint")
    return clinic.visits(spark, sf).select(
        "visit_id", months.alias("num_visits"), early.alias("num_visits_12m")
    )


@query(
    "TS13_progression_correlation",
    ("scores", "proteins"),
    """, r AS (SELECT patient_id, target, max(score) - min(score) AS rng FROM scores WHERE target <> 'updrs_4' GROUP BY 1, 2),
       e AS (SELECT target, quantile_cont(rng, 1/3.0) AS e1, quantile_cont(rng, 2/3.0) AS e2 FROM r GROUP BY target),
       c AS (SELECT patient_id, target, CASE WHEN rng <= e1 THEN 0.0 WHEN rng <= e2 THEN 5.0 WHEN rng IS NOT NULL THEN 10.0 END::double AS y
         FROM r JOIN e USING (target)),
       p AS (SELECT patient_id, UniProt AS feature, max(NPX) - min(NPX) AS x FROM proteins GROUP BY 1, 2),
       j AS (SELECT target, feature, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(y*y) AS syy, sum(x*y) AS sxy
         FROM c JOIN p USING (patient_id) WHERE y IS NOT NULL GROUP BY 1, 2)
       SELECT target, feature, n, round((n*sxy - sx*sy) / (sqrt(n*sxx - sx*sx) * sqrt(n*syy - sy*sy)), 6) AS r FROM j""",
)
def _(spark, sf):
    ranges = cohort.score_range(scores(spark, sf, SCORED_TARGETS)).select("patient_id", "target", "score_range")
    level = cohort.tertile_class(ranges, "score_range", ["target"]).where("level is not null")
    code = fn.map_codes("level", {"low": 0.0, "medium": 5.0, "high": 10.0})
    wide = level.groupBy("patient_id").pivot("target", list(SCORED_TARGETS)).agg(F.first(code))
    spread = clinic.proteins(spark, sf).groupBy("patient_id", F.col("UniProt").alias("feature")).agg(
        (F.max("NPX") - F.min("NPX")).alias("x")
    )
    joined = spread.join(wide, "patient_id")
    x = F.col("x")
    known = lambda e, t: F.sum(F.when(F.col(t).isNotNull(), e))
    sums = joined.groupBy("feature").agg(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("target"),
                    F.count(t).alias("n"),
                    known(x, t).alias("sx"),
                    F.sum(t).alias("sy"),
                    known(x * x, t).alias("sxx"),
                    F.sum(F.col(t) * F.col(t)).alias("syy"),
                    known(x * F.col(t), t).alias("sxy"),
                )
                for t in SCORED_TARGETS
            ]
        ).alias("_m")
    ).select("feature", F.inline("_m"))
    return sums.select("target", "feature", "n", rounded(fn.pearson("n", "sx", "sy", "sxx", "syy", "sxy")).alias("r"))
