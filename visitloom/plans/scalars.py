"""Scalar functions on visits and features."""

from pyspark.sql import functions as F

from visitloom.config import SEVERITY_CODES, TARGETS
from visitloom.functions import scalar as fn
from visitloom.operators import shape
from visitloom.plans.frames import scored, scores
from visitloom.plans.registry import query
from visitloom.sources import clinic
from visitloom.sources.files import table

V = ("visits",)


@query(
    "F01_feature_key",
    ("peptides",),
    """SELECT visit_id, Peptide || '_' || UniProt AS feature,
       UniProt || '_' || Peptide AS feature_rev, PeptideAbundance AS value FROM peptides""",
)
def _(spark, sf):
    return clinic.peptides(spark, sf).select(
        "visit_id",
        fn.feature_key("Peptide", "UniProt").alias("feature"),
        fn.feature_key("Peptide", "UniProt", peptide_first=False).alias("feature_rev"),
        F.col("PeptideAbundance").alias("value"),
    )


@query(
    "F02_visit_key",
    V,
    """SELECT patient_id, visit_month,
       coalesce(CASE WHEN med IS NOT NULL THEN concat('given:', visit_id) END,
                concat(cast(patient_id AS varchar), '_', cast(visit_month AS varchar))) AS visit_id FROM visits""",
)
def _(spark, sf):
    given = F.when(F.col("med").isNotNull(), F.concat(F.lit("given:"), "visit_id"))
    return clinic.visits(spark, sf).select(
        "patient_id", "visit_month", fn.visit_key("patient_id", "visit_month", given).alias("visit_id")
    )


_CAT = """CASE WHEN {c} <= {a} THEN 'mild' WHEN {c} <= {b} THEN 'moderate' ELSE 'severe' END AS {c}_cat"""
_CUTS = {"updrs_1": (10, 21), "updrs_2": (12, 29), "updrs_3": (32, 58), "updrs_4": (4, 12)}


@query(
    "F03_severity",
    V,
    "SELECT visit_id, "
    + ", ".join(_CAT.format(c=c, a=a, b=b) for c, (a, b) in _CUTS.items())
    + " FROM visits",
)
def _(spark, sf):
    v = clinic.visits(spark, sf)
    return v.select("visit_id", *[fn.severity(t, t).alias(f"{t}_cat") for t in TARGETS])


@query(
    "F04_binary_severity",
    V,
    "SELECT visit_id, "
    + ", ".join(f"CASE WHEN {c} <= {a} THEN 0 ELSE 1 END AS {c}_cat" for c, (a, b) in _CUTS.items())
    + " FROM visits",
)
def _(spark, sf):
    v = clinic.visits(spark, sf)
    return v.select("visit_id", *[fn.binary_severity(t, t).alias(f"{t}_cat") for t in TARGETS])


@query(
    "F05_map_and_replace",
    V,
    """, c AS (SELECT visit_id, med, CASE WHEN updrs_1 <= 10 THEN 'mild' WHEN updrs_1 <= 21 THEN 'moderate'
           WHEN updrs_1 IS NULL THEN 'missing' ELSE 'severe' END AS cat FROM visits)
       SELECT visit_id, CASE cat WHEN 'mild' THEN 0 WHEN 'moderate' THEN 1 END AS mapped,
         CASE cat WHEN 'mild' THEN 'low' WHEN 'severe' THEN 'high' ELSE cat END AS replaced,
         CASE med WHEN 'On' THEN 'medicated' ELSE med END AS med FROM c""",
)
def _(spark, sf):
    cat = fn.severity("updrs_1", "updrs_1")
    return clinic.visits(spark, sf).select(
        "visit_id",
        fn.map_codes(cat, {"mild": 0, "moderate": 1}).alias("mapped"),
        fn.replace_codes(cat, {"mild": "low", "severe": "high"}).alias("replaced"),
        fn.replace_codes("med", {"On": "medicated"}).alias("med"),
    )


@query(
    "F06_medication_dummies",
    V,
    """SELECT visit_id, cast(coalesce(med, 'Unknown') = 'On' AS int) AS med_on,
       cast(coalesce(med, 'Unknown') = 'Unknown' AS int) AS med_unknown FROM visits""",
)
def _(spark, sf):
    d = fn.medication_dummies("med")
    return clinic.visits(spark, sf).select("visit_id", *[c.alias(n) for n, c in d.items()])


@query(
    "F07_medication_domain_check",
    (),
    """SELECT o_orderkey, state, cast(state = 'On' AS int) AS med_on, cast(state = 'Unknown' AS int) AS med_unknown,
         state IN ('On', 'Off', 'Unknown') AS valid
       FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'On' WHEN 'O' THEN 'Off'
             ELSE CASE WHEN o_orderpriority LIKE '1%' THEN 'Unknown' ELSE o_orderstatus END END AS state FROM orders)""",
)
def _(spark, sf):
    from visitloom.operators.labels import check_medication

    state = (
        F.when(F.col("o_orderstatus") == "F", "On")
        .when(F.col("o_orderstatus") == "O", "Off")
        .when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus"))
    )
    raw = table(spark, sf, "orders").select("o_orderkey", state.alias("med"))
    checked = check_medication(raw, "med")
    return checked.select(
        "o_orderkey", F.coalesce("med", F.lit("Unknown")).alias("state"), "med_on", "med_unknown", "valid"
    )


@query(
    "F08_visit_sums",
    ("feats",),
    """SELECT visit_id, cast(sum(cast(value AS decimal(18,2))) AS double) AS num_prot_pep,
       coalesce(cast(sum(CASE WHEN kind = 'protein' THEN cast(value AS decimal(18,2)) END) AS double), 0.0) AS num_prot,
       coalesce(cast(sum(CASE WHEN kind = 'peptide' THEN cast(value AS decimal(18,2)) END) AS double), 0.0) AS num_pept
       FROM feats GROUP BY visit_id""",
)
def _(spark, sf):
    totals = shape.visit_totals(clinic.features(spark, sf))
    return totals.select("visit_id", "num_prot_pep", "num_prot", "num_pept")


@query(
    "F09_visit_counts",
    ("feats",),
    """SELECT visit_id, count(*) FILTER (kind = 'protein' AND value > 0) AS n_prot_gt_0,
       count(*) FILTER (kind = 'peptide' AND value > 0) AS n_pept_gt_0 FROM feats GROUP BY visit_id""",
)
def _(spark, sf):
    totals = shape.visit_totals(clinic.features(spark, sf))
    return totals.select("visit_id", "n_prot_gt_0", "n_pept_gt_0")


@query(
    "F10_row_max_min",
    V,
    """SELECT visit_id, greatest(updrs_1, updrs_2, updrs_3, updrs_4) AS max_score,
       least(updrs_1, updrs_2, updrs_3, updrs_4) AS min_score FROM visits""",
)
def _(spark, sf):
    return clinic.visits(spark, sf).select(
        "visit_id", F.greatest(*TARGETS).alias("max_score"), F.least(*TARGETS).alias("min_score")
    )


@query(
    "F11_protein_of_feature",
    ("feats",),
    """, f AS (SELECT DISTINCT feature FROM feats UNION SELECT DISTINCT replace(p_name, ' ', '_') || '_' || p_brand FROM part)
       SELECT feature, list_last(string_split(feature, '_')) AS protein,
         CASE WHEN contains(feature, '_') THEN string_split(feature, '_')[2] ELSE feature END AS protein_legacy FROM f""",
)
def _(spark, sf):
    measured = clinic.features(spark, sf).select("feature")
    # names with underscores of their own, as modified peptides have
    modified = table(spark, sf, "part").select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_brand").alias("feature")
    )
    return measured.union(modified).distinct().select(
        "feature",
        fn.protein_of("feature").alias("protein"),
        fn.protein_of("feature", legacy=True).alias("protein_legacy"),
    )


@query(
    "F12_display_label",
    ("scored",),
    """SELECT visit_id, target, CASE WHEN p >= 0.5
         THEN CASE target WHEN 'updrs_1' THEN '> 10' WHEN 'updrs_2' THEN '> 12' ELSE '> 32' END || ' (Moderate-to-Severe)'
         ELSE CASE target WHEN 'updrs_1' THEN '< 11' WHEN 'updrs_2' THEN '< 13' ELSE '< 33' END || ' (None-to-Mild)' END AS display
       FROM scored""",
)
def _(spark, sf):
    s = scored(spark, sf)
    return s.select(
        "visit_id", "target", fn.severity_label("target", (F.col("p") >= 0.5).cast("int")).alias("display")
    )


@query(
    "F13_square_and_inverse",
    ("feats",),
    """SELECT visit_id, feature || '^2' AS feature, round(value*value, 4) AS value FROM feats
       UNION ALL SELECT visit_id, feature || '_inverse', round(1/nullif(value, 0), 6) FROM feats""",
)
def _(spark, sf):
    f = clinic.features(spark, sf)
    return f.select(
        "visit_id",
        F.inline(
            F.array(
                F.struct(
                    F.concat("feature", F.lit("^2")).alias("feature"),
                    F.round(F.col("value") * F.col("value"), 4).alias("value"),
                ),
                F.struct(
                    F.concat("feature", F.lit("_inverse")).alias("feature"),
                    F.round(F.try_divide(F.lit(1.0), "value"), 6).alias("value"),
                ),
            )
        ),
    )


@query(
    "F14_suffix_removal",
    ("scores",),
    """SELECT visit_id, regexp_replace(target || '_cat', '_cat$', '') AS target,
       replace(coalesce(med, 'Unknown'), 'nown', '') AS med FROM scores""",
)
def _(spark, sf):
    return scores(spark, sf).select(
        "visit_id",
        F.regexp_replace(F.concat("target", F.lit("_cat")), "_cat$", "").alias("target"),
        F.replace(F.coalesce("med", F.lit("Unknown")), F.lit("nown"), F.lit("")).alias("med"),
    )


@query(
    "F15_casts",
    ("visits",),
    """SELECT cast(patient_id AS varchar) AS patient, cast(cast(updrs_1 AS double) AS int) AS score,
       try_cast(replace(visit_id, '_', '-') AS int) AS visit_number, try_cast(cast(updrs_2 AS varchar) AS int) AS score_2 FROM visits""",
)
def _(spark, sf):
    return clinic.visits(spark, sf).select(
        F.col("patient_id").cast("string").alias("patient"),
        F.col("updrs_1").cast("double").cast("int").alias("score"),
        F.expr("try_cast(replace(visit_id, '_', '-') AS int)").alias("visit_number"),
        F.expr("try_cast(cast(updrs_2 AS string) AS int)").alias("score_2"),
    )


@query(
    "F16_sign_flag",
    V,
    """SELECT visit_id, CASE WHEN updrs_4 = 0 THEN 0 WHEN updrs_4 > 0 THEN 1 END AS updrs_4_flag FROM visits""",
)
def _(spark, sf):
    return clinic.visits(spark, sf).select("visit_id", fn.sign_flag("updrs_4").alias("updrs_4_flag"))


@query(
    "F17_threshold_call",
    ("scored",),
    """SELECT visit_id, target, cast(p >= CASE target WHEN 'updrs_1' THEN 0.46 WHEN 'updrs_2' THEN 0.22
       ELSE 0.28 END::double AS int) AS pred FROM scored""",
)
def _(spark, sf):
    return scored(spark, sf).select("visit_id", "target", fn.call_at_threshold("target", "p").alias("pred"))


@query(
    "F18_round_half_even",
    V,
    """SELECT visit_id, cast(round_even(updrs_1 / 2.0::double, 0) AS int) AS half_score FROM visits""",
)
def _(spark, sf):
    return clinic.visits(spark, sf).select(
        "visit_id", F.bround(F.col("updrs_1") / F.lit(2.0), 0).cast("int").alias("half_score")
    )


@query(
    "F19_pair_products",
    ("proteins",),
    """SELECT a.visit_id, a.UniProt || '_' || b.UniProt AS feature, a.NPX * b.NPX AS value
       FROM proteins a JOIN proteins b ON a.visit_id = b.visit_id AND a.UniProt < b.UniProt""",
)
def _(spark, sf):
    return shape.pair_products(clinic.protein_features(spark, sf))


@query(
    "F20_label_encode",
    V,
    """SELECT visit_id, cast(dense_rank() OVER (ORDER BY cat) - 1 AS int) AS code FROM (
       SELECT visit_id, CASE WHEN updrs_1 <= 10 THEN 'mild' WHEN updrs_1 <= 21 THEN 'moderate' ELSE 'severe' END AS cat FROM visits)""",
)
def _(spark, sf):
    from visitloom.operators.labels import encode_labels

    cat = fn.severity("updrs_1", "updrs_1")
    v = clinic.visits(spark, sf).select("visit_id", cat.alias("cat"))
    return encode_labels(v, "cat", list(SEVERITY_CODES), "code").select("visit_id", "code")
