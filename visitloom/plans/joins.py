"""Join queries."""

from pyspark.sql import functions as F

from visitloom.config import FIRST_YEAR, SCORED_TARGETS
from visitloom.functions import scalar as fn
from visitloom.operators import labels, longitudinal, shape
from visitloom.plans.frames import scored
from visitloom.plans.registry import query
from visitloom.sources import clinic
from visitloom.sources.files import table

V = ("visits",)


@query(
    "J01_protein_left_peptide",
    ("proteins", "peptides"),
    """SELECT visit_id, 'protein' AS kind, UniProt AS feature, NPX AS value FROM proteins WHERE NPX > 50000
       UNION ALL SELECT visit_id, 'peptide', Peptide || '_' || UniProt, PeptideAbundance FROM peptides
       WHERE visit_id IN (SELECT visit_id FROM proteins WHERE NPX > 50000)""",
)
def _(spark, sf):
    # only strong protein signals, so that some visits have peptides alone
    prot = clinic.proteins(spark, sf).where("NPX > 50000")
    return shape.long_features(prot, clinic.peptides(spark, sf))


@query(
    "J02_clinical_inner_features",
    ("visits", "feats"),
    """SELECT v.visit_id, v.patient_id, v.visit_month, v.updrs_1, f.feature, f.value
       FROM visits v JOIN feats f USING (visit_id) WHERE f.kind = 'protein'""",
)
def _(spark, sf):
    v = clinic.visits(spark, sf).select("visit_id", "patient_id", "visit_month", "updrs_1")
    f = clinic.protein_features(spark, sf).select("visit_id", "feature", "value")
    return v.join(f, "visit_id")


@query(
    "J03_left_enrich",
    ("visits", "proteins"),
    """, e AS (SELECT visit_id, count(*) AS n_prot, cast(sum(cast(NPX AS decimal(18,2))) AS double) AS num_prot
         FROM proteins GROUP BY visit_id)
       SELECT v.visit_id, v.updrs_1, e.n_prot, e.num_prot FROM visits v LEFT JOIN e USING (visit_id)""",
)
def _(spark, sf):
    extra = clinic.proteins(spark, sf).groupBy("visit_id").agg(
        F.count(F.lit(1)).alias("n_prot"),
        fn.from_cents(F.sum(fn.cents("NPX"))).alias("num_prot"),
    )
    return clinic.visits(spark, sf).select("visit_id", "updrs_1").join(extra, "visit_id", "left")


@query(
    "J04_attach_group_aggregate",
    (),
    """SELECT o_orderkey, o_custkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey) AS max_price
       FROM orders""",
)
def _(spark, sf):
    from visitloom.operators.skew import attach_aggregate

    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return attach_aggregate(o, ["o_custkey"], F.max("o_totalprice").alias("max_price"))


@query(
    "J05_inner_dummies",
    ("visits", "feats"),
    """, t AS (SELECT visit_id, count(*) AS n_features FROM feats GROUP BY visit_id)
       SELECT t.visit_id, n_features, cast(coalesce(med, 'Unknown') = 'On' AS int) AS med_on,
         cast(coalesce(med, 'Unknown') = 'Unknown' AS int) AS med_unknown FROM t JOIN visits USING (visit_id)""",
)
def _(spark, sf):
    counts = clinic.features(spark, sf).groupBy("visit_id").agg(F.count(F.lit(1)).alias("n_features"))
    d = fn.medication_dummies("med")
    dummies = clinic.visits(spark, sf).select("visit_id", *[c.alias(n) for n, c in d.items()])
    return counts.join(dummies, "visit_id")


@query(
    "J06_assemble_predictions",
    ("scored",),
    """, t AS (SELECT visit_id, target, label, cast(p >= 0.5 AS int) AS pred FROM scored)
       SELECT a.visit_id, a.label AS updrs_1_cat, a.pred AS updrs_1_pred, b.label AS updrs_2_cat,
         b.pred AS updrs_2_pred, c.label AS updrs_3_cat, c.pred AS updrs_3_pred
       FROM (SELECT * FROM t WHERE target = 'updrs_1') a
       JOIN (SELECT * FROM t WHERE target = 'updrs_2') b USING (visit_id)
       LEFT JOIN (SELECT * FROM t WHERE target = 'updrs_3') c USING (visit_id)""",
)
def _(spark, sf):
    s = scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return longitudinal.assemble_predictions(s)


_PAIRS = """SELECT a.visit_id, a.patient_id, a.visit_month, b.visit_month AS visit_month_2,
         b.visit_month - a.visit_month AS visit_month_diff
       FROM visits a JOIN visits b ON a.patient_id = b.patient_id AND a.visit_month <> b.visit_month"""


@query("J07_visit_pairs", V, _PAIRS)
def _(spark, sf):
    return longitudinal.visit_pairs(
        clinic.visits(spark, sf).select("visit_id", "patient_id", "visit_month")
    )


@query(
    "J08_two_key_join",
    ("visits", "proteins"),
    """, m AS (SELECT patient_id, visit_month, max(NPX) AS top_npx FROM proteins GROUP BY patient_id, visit_month)
       SELECT patient_id, visit_month, updrs_1, top_npx FROM visits JOIN m USING (patient_id, visit_month)""",
)
def _(spark, sf):
    m = clinic.proteins(spark, sf).groupBy("patient_id", "visit_month").agg(F.max("NPX").alias("top_npx"))
    v = clinic.visits(spark, sf).select("patient_id", "visit_month", "updrs_1")
    return v.join(m, ["patient_id", "visit_month"])


@query(
    "J09_renamed_key_join",
    V,
    """, mean AS (SELECT visit_month AS month_2, avg(cast(updrs_1 AS double)) AS mean_score FROM visits GROUP BY visit_month)
       SELECT v.visit_id, v.visit_month AS month, round(mean_score, 6) AS mean_score
       FROM visits v LEFT JOIN mean ON mean.month_2 = v.visit_month""",
)
def _(spark, sf):
    v = clinic.visits(spark, sf)
    # one row per month: bounded by the calendar
    means = v.groupBy(F.col("visit_month").alias("month_2")).agg(
        fn.rounded(F.avg(F.col("updrs_1").cast("double"))).alias("mean_score")
    )
    joined = v.alias("v").join(F.broadcast(means), F.col("v.visit_month") == F.col("month_2"), "left")
    return joined.select("visit_id", F.col("visit_month").alias("month"), "mean_score")


@query(
    "J10_dimension_lookup",
    ("feats",),
    """, d AS (SELECT p_brand AS protein, count(*) AS length, CASE WHEN min(p_size) > 1 THEN min(p_name) END AS protein_name
         FROM part GROUP BY p_brand),
       f AS (SELECT DISTINCT feature, list_last(string_split(feature, '_')) AS protein FROM feats)
       SELECT feature, protein, coalesce(protein_name, 'Unknown') AS protein_name, length FROM f JOIN d USING (protein)""",
)
def _(spark, sf):
    lookup = (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("protein"))
        .agg(
            F.count(F.lit(1)).alias("length"),
            F.when(F.min("p_size") > 1, F.min("p_name")).alias("protein_name"),
        )
    )
    names = clinic.features(spark, sf).select("feature").distinct()
    joined = names.withColumn("protein", fn.protein_of("feature")).join(lookup, "protein")
    return joined.na.fill("Unknown", ["protein_name"]).select("feature", "protein", "protein_name", "length")


@query(
    "J11_predictions_by_month",
    ("scored",),
    """, t AS (SELECT patient_id, visit_month, target, cast(p >= 0.5 AS int) AS pred FROM scored)
       SELECT patient_id, visit_month, max(pred) FILTER (target = 'updrs_1') AS updrs_1_pred,
         max(pred) FILTER (target = 'updrs_2') AS updrs_2_pred, max(pred) FILTER (target = 'updrs_3') AS updrs_3_pred
       FROM t GROUP BY patient_id, visit_month
       HAVING updrs_1_pred IS NOT NULL AND updrs_2_pred IS NOT NULL AND updrs_3_pred IS NOT NULL""",
)
def _(spark, sf):
    s = scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    # the three inner joins on one key are one pivot that keeps complete rows
    wide = s.groupBy("patient_id", "visit_month").pivot("target", list(SCORED_TARGETS)).agg(F.first("pred"))
    complete = wide.na.drop("any", subset=list(SCORED_TARGETS))
    return complete.select(
        "patient_id", "visit_month", *[F.col(t).alias(f"{t}_pred") for t in SCORED_TARGETS]
    )


@query(
    "J12_baseline_lookup",
    V,
    """SELECT v.visit_id, b.updrs_1 AS baseline_1, b.updrs_2 AS baseline_2 FROM visits v
       LEFT JOIN (SELECT patient_id, updrs_1, updrs_2 FROM visits WHERE visit_month = 0) b USING (patient_id)""",
)
def _(spark, sf):
    v = labels.attach_month_zero(clinic.visits(spark, sf), ["updrs_1", "updrs_2"])
    return v.select(
        "visit_id",
        F.col("updrs_1_0_month").alias("baseline_1"),
        F.col("updrs_2_0_month").alias("baseline_2"),
    )


@query(
    "J13_side_by_side",
    ("visits", "proteins"),
    """, s AS (SELECT visit_id, cast(sum(cast(NPX AS decimal(18,2))) AS double) AS num_prot FROM proteins GROUP BY visit_id)
       SELECT visit_id, patient_id, visit_month, num_prot FROM visits JOIN s USING (visit_id)
       WHERE visit_month <= 12""",
)
def _(spark, sf):
    sums = clinic.proteins(spark, sf).groupBy("visit_id").agg(
        fn.from_cents(F.sum(fn.cents("NPX"))).alias("num_prot")
    )
    v = clinic.visits(spark, sf).where(F.col("visit_month") <= FIRST_YEAR)
    return v.select("visit_id", "patient_id", "visit_month").join(sums, "visit_id")
