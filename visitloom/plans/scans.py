"""Sources, sinks, projections and filters."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.config import FIRST_YEAR, SCORED_TARGETS, TARGETS
from visitloom.functions.scalar import rounded, shuffle_bucket, shuffle_key
from visitloom.operators import ranking, shape
from visitloom.plans.frames import scored, stored_features
from visitloom.plans.registry import query
from visitloom.session import fresh_path
from visitloom.sources import clinic, contract, files, records
from visitloom.sources.files import table

V = ("visits",)


@query("S01_csv_scan", V, "SELECT * FROM visits")
def _(spark, sf):
    path = fresh_path(spark, "visits-csv")
    clinic.visits(spark, sf).write.option("header", True).csv(path)
    return files.read_visits(spark, path)


@query(
    "S01_parquet_scan",
    (),
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice > 250000""",
)
def _(spark, sf):
    return (
        table(spark, sf, "orders")
        .where("o_orderstatus = 'F' and o_totalprice > 250000")
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )


_PROPS = """SELECT cast(event_id AS varchar) AS visit_id, j.key AS feature,
    try_cast(json_extract_string(props, '$."' || j.key || '"') AS double) AS value
  FROM events, (SELECT unnest(json_keys(props)) AS key, event_id AS e FROM events WHERE json_valid(props)) j
  WHERE j.e = event_id AND try_cast(json_extract_string(props, '$."' || j.key || '"') AS double) IS NOT NULL"""


@query("S02_json_records", (), _PROPS)
def _(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("visit_id"), records.decode("props").alias("fields")
    )
    return records.feature_rows(events)


@query("S02_json_records_double_encoded", (), _PROPS)
def _(spark, sf):
    quoted = F.concat(
        F.lit('"'),
        F.replace(F.replace("props", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
        F.lit('"'),
    )
    events = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("visit_id"), records.decode(quoted).alias("fields")
    )
    return records.feature_rows(events)


@query(
    "S02_json_visit_files",
    ("visits", "proteins"),
    """SELECT v.visit_id, v.patient_id, v.visit_month, v.med, UniProt AS feature, NPX AS value
       FROM visits v JOIN proteins p USING (visit_id)""",
)
def _(spark, sf):
    path = fresh_path(spark, "records")
    visits, feats = clinic.visits(spark, sf), clinic.protein_features(spark, sf)
    records.write_records(visits, feats, path)
    lines = spark.read.text(path).select(records.decode("value").alias("fields"))
    read = records.visit_fields(lines)
    return read.drop("fields").join(records.feature_rows(read), "visit_id")


@query(
    "S03_table_sink",
    ("scores",),
    "SELECT visit_id, visit_month, target, score FROM scores WHERE score IS NOT NULL",
)
def _(spark, sf):
    from visitloom.plans.frames import scores

    path = fresh_path(spark, "by-target")
    long = scores(spark, sf).where("score is not null")
    files.write_by_target(long.select("visit_id", "visit_month", "target", "score"), path)
    return spark.read.schema("visit_id string, visit_month int, score int, target string").parquet(
        path
    )


@query(
    "S04_json_sink",
    ("scored",),
    "SELECT visit_id, target, label, round(p, 6) AS p FROM scored",
)
def _(spark, sf):
    path = fresh_path(spark, "predictions")
    preds = scored(spark, sf).select("visit_id", "target", "label", rounded("p").alias("p"))
    files.write_predictions_json(preds, path)
    return spark.read.schema(preds.schema).json(path)


@query(
    "S05_feature_contract",
    ("feats",),
    """SELECT target, cast(row_number() OVER (PARTITION BY target ORDER BY feature) - 1 AS int) AS pos, feature
       FROM (SELECT DISTINCT feature FROM feats), (VALUES ('updrs_1'), ('updrs_2'), ('updrs_3')) t(target)""",
)
def _(spark, sf):
    built = contract.contract_of(clinic.features(spark, sf), SCORED_TARGETS)
    lists = built.groupBy("target").agg(
        F.to_json(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "feature"))), lambda s: s["feature"])
        ).alias("features")
    )
    path = fresh_path(spark, "contract")
    lists.write.parquet(path)
    return contract.explode_contract(spark.read.schema("target string, features string").parquet(path))


@query(
    "S06_hyper_parameters",
    ("scores",),
    """, w AS (
      SELECT 'max_depth' AS param, target, cast(max(score) AS double) AS value FROM scores GROUP BY target
      UNION ALL SELECT 'subsample', target, avg(cast(score AS double))/100 FROM scores GROUP BY target
      UNION ALL SELECT 'boosting', target, cast(max(score) % 3 AS double) FROM scores GROUP BY target)
    SELECT param, target, round(value, 6) AS value,
      CASE param WHEN 'max_depth' THEN cast(cast(value AS int) AS varchar)
        WHEN 'boosting' THEN CASE cast(value AS int) WHEN 0 THEN 'gbdt' WHEN 1 THEN 'dart' ELSE 'rf' END
        ELSE cast(round(value, 6) AS varchar) END AS decoded
    FROM w""",
)
def _(spark, sf):
    v = clinic.visits(spark, sf)
    wide = v.agg(
        *[F.max(t).cast("double").alias(f"max_depth|{t}") for t in TARGETS],
        *[(F.avg(F.col(t).cast("double")) / 100).alias(f"subsample|{t}") for t in TARGETS],
        *[(F.max(t) % 3).cast("double").alias(f"boosting|{t}") for t in TARGETS],
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(p).alias("param"), *[F.col(f"`{p}|{t}`").alias(t) for t in TARGETS])
                    for p in ("max_depth", "subsample", "boosting")
                ]
            )
        )
    )
    path = fresh_path(spark, "params")
    wide.write.option("header", True).csv(path)
    schema = T.StructType(
        [T.StructField("param", T.StringType())] + [T.StructField(t, T.DoubleType()) for t in TARGETS]
    )
    long = contract.unpivot_params(files.read_csv(spark, path, schema), TARGETS)
    return contract.decode_params(long, {"boosting": ["gbdt", "dart", "rf"]}, ("max_depth",))


@query(
    "P01_select_rename_drop",
    V,
    "SELECT visit_id, patient_id, visit_month AS month, updrs_1 FROM visits",
)
def _(spark, sf):
    v = clinic.visits(spark, sf).drop("med", "updrs_2", "updrs_3", "updrs_4")
    return v.withColumnRenamed("visit_month", "month")


@query("P02_month_window", V, "SELECT * FROM visits WHERE visit_month <= 12")
def _(spark, sf):
    return clinic.visits(spark, sf).where(F.col("visit_month") <= FIRST_YEAR)


@query("P02_month_equal", V, "SELECT visit_id, updrs_1 FROM visits WHERE visit_month = 12")
def _(spark, sf):
    v = clinic.visits(spark, sf).where(F.col("visit_month") == FIRST_YEAR)
    return v.select("visit_id", "updrs_1")


@query(
    "P03_drop_null_any",
    V,
    """SELECT * FROM visits WHERE updrs_1 IS NOT NULL AND updrs_2 IS NOT NULL
       AND updrs_3 IS NOT NULL AND updrs_4 IS NOT NULL AND med IS NOT NULL""",
)
def _(spark, sf):
    return clinic.visits(spark, sf).na.drop("any")


@query(
    "P03_drop_null_subset",
    V,
    "SELECT * FROM visits WHERE updrs_2 IS NOT NULL AND updrs_3 IS NOT NULL",
)
def _(spark, sf):
    return clinic.visits(spark, sf).na.drop("any", subset=["updrs_2", "updrs_3"])


@query(
    "P04_null_fill",
    V,
    """SELECT visit_id, coalesce(updrs_2, 0) AS updrs_2, coalesce(updrs_4, 0) AS updrs_4,
       coalesce(med, 'Unknown') AS med FROM visits""",
)
def _(spark, sf):
    v = clinic.visits(spark, sf).select("visit_id", "updrs_2", "updrs_4", "med")
    return v.na.fill({"updrs_2": 0, "updrs_4": 0, "med": "Unknown"})


@query("P05_distinct_sorted", ("proteins",), "SELECT DISTINCT UniProt FROM proteins ORDER BY 1")
def _(spark, sf):
    return clinic.proteins(spark, sf).select("UniProt").distinct().orderBy("UniProt")


@query(
    "P06_first_of_duplicate_names",
    (),
    """SELECT l_orderkey, p_brand AS feature, l_extendedprice AS value FROM (
         SELECT l_orderkey, p_brand, l_extendedprice,
           row_number() OVER (PARTITION BY l_orderkey, p_brand ORDER BY l_linenumber, l_extendedprice) AS rn
         FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE rn = 1""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    named = lines.select(
        "l_orderkey", F.col("p_brand").alias("feature"), "l_linenumber", F.col("l_extendedprice").alias("value")
    )
    return shape.first_of_name(named, ["l_orderkey", "feature"], "value", ["l_linenumber"])


@query(
    "P07_conform_to_contract",
    ("feats",),
    """, c AS (SELECT feature, cast(row_number() OVER (ORDER BY feature) - 1 AS int) AS pos FROM (
        SELECT DISTINCT feature FROM feats WHERE kind = 'protein' UNION SELECT r_name FROM region)),
      s AS (SELECT DISTINCT visit_id FROM feats)
      SELECT s.visit_id, 'updrs_1' AS target, c.pos, c.feature, coalesce(f.value, 0.0) AS value
      FROM s CROSS JOIN c LEFT JOIN feats f ON f.visit_id = s.visit_id AND f.feature = c.feature""",
)
def _(spark, sf):
    feats = stored_features(spark, sf)
    # the protein names plus five names that no sample carries
    names = table(spark, sf, "part").select(F.col("p_brand").alias("feature"))
    sampled = names.join(feats.select("feature").distinct(), "feature", "left_semi")
    extra = table(spark, sf, "region").select(F.col("r_name").alias("feature"))
    wanted = contract.contract_of(sampled.unionByName(extra), ["updrs_1"])
    visits = feats.select("visit_id").distinct().withColumn("target", F.lit("updrs_1"))
    return shape.conform(visits, wanted, feats)


@query(
    "P08_membership",
    V,
    """SELECT count(*) AS n_rows, count(DISTINCT patient_id) AS n_patients FROM visits
       WHERE patient_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _(spark, sf):
    chosen = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    chosen = chosen.select(F.col("c_custkey").alias("patient_id"))
    v = clinic.visits(spark, sf).join(chosen, "patient_id", "left_semi")
    return v.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("patient_id").alias("n_patients"))


@query(
    "P08_membership_disjoint",
    V,
    """SELECT count(*) AS n_rows FROM visits WHERE patient_id IN
       (SELECT -1 - s_suppkey FROM supplier)""",
)
def _(spark, sf):
    # supplier keys moved below zero: ids of people who are not in the visits
    others = table(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("patient_id"))
    v = clinic.visits(spark, sf).join(others, "patient_id", "left_semi")
    return v.agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "P09_non_membership",
    V,
    """SELECT DISTINCT patient_id FROM visits v WHERE NOT EXISTS
       (SELECT 1 FROM visits w WHERE w.patient_id = v.patient_id AND w.visit_month = 12)""",
)
def _(spark, sf):
    # one pass: the flag is an aggregate, so the visits are not joined with themselves
    v = clinic.visits(spark, sf)
    flags = v.groupBy("patient_id").agg(F.bool_or(F.col("visit_month") == FIRST_YEAR).alias("_has"))
    return flags.where(~F.col("_has")).select("patient_id")


@query(
    "P10_name_pattern",
    ("feats",),
    """SELECT visit_id, feature, value FROM feats
       WHERE regexp_matches(feature, '^[A-Z]+_.*') AND contains(feature, 'Brand#1')""",
)
def _(spark, sf):
    f = clinic.features(spark, sf)
    keep = F.col("feature").rlike("^[A-Z]+_.*") & F.col("feature").contains("Brand#1")
    return f.where(keep).select("visit_id", "feature", "value")


@query("P10_column_pattern", V, "SELECT updrs_1, updrs_2, updrs_3, updrs_4, visit_id FROM visits")
def _(spark, sf):
    v = clinic.visits(spark, sf)
    return v.select(v.colRegex("`updrs_.*`"), "visit_id")


@query(
    "P11_seeded_shuffle",
    V,
    """SELECT visit_id, row_number() OVER (ORDER BY md5(concat('42:', visit_id))) - 1 AS row_index
       FROM visits""",
)
def _(spark, sf):
    v = clinic.visits(spark, sf).select("visit_id", shuffle_key(42, "visit_id").alias("_k"))
    cells = v.withColumn("_one", F.lit(1))
    placed = ranking.running(cells, [], ["_k"], {"_one": "row_index"}, shuffle_bucket("_k"))
    return placed.select("visit_id", "row_index")


@query(
    "P12_wrong_predictions",
    ("scored",),
    """, w AS (SELECT target, label, cast(p >= 0.5 AS int) AS pred FROM scored)
       SELECT target, label, count(*) AS n_wrong FROM w WHERE label <> pred GROUP BY target, label""",
)
def _(spark, sf):
    s = scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    wrong = s.where(~F.col("label").eqNullSafe(F.col("pred")))
    return wrong.groupBy("target", "label").agg(F.count(F.lit(1)).alias("n_wrong"))


@query(
    "P13_patient_month_slice",
    V,
    """, pick AS (SELECT patient_id, max(visit_month) AS visit_month FROM visits
         GROUP BY patient_id ORDER BY count(*) DESC, patient_id LIMIT 1)
       SELECT v.* FROM visits v JOIN pick USING (patient_id, visit_month)""",
)
def _(spark, sf):
    # the slice of the patient with the most visits, at that patient's last month
    v = clinic.visits(spark, sf)
    pick = (
        v.groupBy("patient_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("visit_month").alias("visit_month"))
        .orderBy(F.desc("_n"), "patient_id")
        .limit(1)
        .select("patient_id", "visit_month")
    )
    return v.join(F.broadcast(pick), ["patient_id", "visit_month"])


@query(
    "P14_positional_header",
    (),
    "SELECT l_orderkey AS visit, l_partkey AS feature, l_quantity AS value FROM lineitem",
)
def _(spark, sf):
    path = fresh_path(spark, "headless")
    table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").write.csv(path)
    raw = spark.read.schema("_c0 bigint, _c1 bigint, _c2 double").csv(path)
    return files.name_by_position(raw, ["visit", "feature", "value"])
