"""Queries over what is kept between runs: laid-out tables, sketches, stream state."""

import uuid

from pyspark.sql import functions as F

from visitloom.config import TARGETS
from visitloom.functions.scalar import cents, from_cents, rounded
from visitloom.operators import sketches
from visitloom.plans.frames import scores
from visitloom.plans.registry import query
from visitloom.session import fresh_path, materialize
from visitloom.sources import clinic, layout, records
from visitloom.streaming import baseline

BUCKETS = 8  # of the test tables; layout.buckets_for gives the number for a size


@query(
    "S03_bucketed_enrich",
    ("visits", "proteins"),
    """, e AS (SELECT visit_id, count(*) AS n_prot, cast(sum(cast(NPX AS decimal(18,2))) AS double) AS num_prot
         FROM proteins GROUP BY visit_id)
       SELECT v.visit_id, v.patient_id, v.visit_month, e.n_prot, e.num_prot FROM visits v LEFT JOIN e USING (visit_id)""",
)
def _(spark, sf):
    mark = uuid.uuid4().hex
    visits = layout.write_bucketed(clinic.visits(spark, sf), f"visits_{mark}", "visit_id", BUCKETS)
    features = layout.write_bucketed(clinic.protein_features(spark, sf), f"proteins_{mark}", "visit_id", BUCKETS)
    return bucketed_totals(visits, features)


def bucketed_totals(visits, features):
    """Visits with the number and sum of their features, from tables bucketed by visit."""
    totals = features.groupBy("visit_id").agg(
        F.count("*").alias("n_prot"), from_cents(F.sum(cents("value"))).alias("num_prot")
    )
    return layout.join_stored(visits.select("visit_id", "patient_id", "visit_month"), totals, "visit_id", "left")


# Windows of months, first and last.
WINDOWS = {"first_year": (0, 12), "second_year": (13, 24), "all": (0, 1 << 20)}
PROBABILITIES = {"q33": 0.33, "q66": 0.66}


@query(
    "A15_quantile_sketches",
    ("scores",),
    """, w AS (SELECT target, score, unnest(list_filter([
           CASE WHEN visit_month <= 12 THEN 'first_year' END,
           CASE WHEN visit_month BETWEEN 13 AND 24 THEN 'second_year' END, 'all'], lambda x: x IS NOT NULL)) AS "window"
         FROM scores WHERE score IS NOT NULL)
       SELECT target, "window", count(*) AS n, round(quantile_cont(score, 0.33), 6) AS q33_exact,
              round(quantile_cont(score, 0.66), 6) AS q66_exact, true AS within_bound
       FROM w GROUP BY ALL""",
)
def _(spark, sf):
    known = materialize(scores(spark, sf), "scores")
    table = materialize(sketches.monthly(known), "sketches")
    both = sketches.compared(known, table, WINDOWS, PROBABILITIES)
    return both.select(
        "target", "window", "n", rounded("q33_exact").alias("q33_exact"), rounded("q66_exact").alias("q66_exact"),
        (F.greatest("q33_error", "q66_error") <= sketches.RANK_ERROR).alias("within_bound"),
    )


@query(
    "ST1_change_stream",
    ("scores",),
    """SELECT visit_id, target,
         score - max(CASE WHEN visit_month = 0 THEN score END) OVER (PARTITION BY patient_id, target) AS change
       FROM scores""",
)
def _(spark, sf):
    arriving, sink, checkpoint = (fresh_path(spark, n) for n in ("arriving", "changes", "checkpoint"))
    visits = materialize(clinic.visits(spark, sf), "visits")
    sent = records.encode(
        visits.select("visit_id", "patient_id", "visit_month", "med"),
        visits.unpivot(["visit_id"], list(TARGETS), "feature", "value").where("value is not null"),
    )
    # every record twice, the two apart and out of order
    copies = sent.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    n_files = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = copies.withColumn("_file", F.xxhash64("visit_id", "_copy")).repartition(n_files, "_file")
    dealt.sortWithinPartitions("_file").select("record").write.text(arriving)
    # three batches, however many files
    visits = baseline.arriving_scores(spark, arriving, TARGETS, files=-(-3 * n_files // 8))
    stream = baseline.changes(visits, TARGETS, wait_ms=86_400_000)
    baseline.run_available(stream, sink, checkpoint)
    return spark.read.schema(baseline.CHANGES).parquet(sink).select("visit_id", "target", "change")
