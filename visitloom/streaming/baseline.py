"""Change since the first visit, kept up to date over arriving visit records.

A patient's state is the month-0 scores, the months already seen and the visits
that still wait for month 0. It is bounded by the calendar, however many records
arrive, since a record sent again adds nothing. The patients of a bucket are kept
together, as a call for each patient costs far more than its records do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from visitloom.sources import records
from visitloom.streaming import score

# Fixed for the life of a checkpoint. A bucket's state grows with its patients.
BUCKETS = 2_048
CHANGES = "visit_id string, patient_id bigint, visit_month int, target string, change int"


def arriving_scores(spark: SparkSession, source: str, targets: tuple[str, ...], files: int) -> DataFrame:
    """Streaming (visit_id, patient_id, visit_month, scores) of the record files in ``source``.

    ``files`` bounds what a micro-batch reads. Lines that are no records, and
    records without patient or month, are no visits and are left out.
    """
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(source)
    decoded = lines.select(records.decode("value").alias("fields")).where("fields is not null")
    score = [F.try_element_at("fields", F.lit(t)).try_cast("double").cast("int") for t in targets]
    return (
        records.visit_fields(decoded)
        .where("patient_id is not null and visit_month is not null")
        .select("visit_id", "patient_id", "visit_month", F.array(*score).alias("scores"))
    )


def changes(visits: DataFrame, targets: tuple[str, ...], wait_ms: int) -> DataFrame:
    """(visit_id, patient_id, visit_month, target, change) of a stream of visits, each month once.

    A visit before its patient's month 0 waits for it. After ``wait_ms`` it goes
    out with a NULL change; visits after that wait anew, and a month 0 that comes
    late serves those only. Of a month sent more than once the first that is read
    counts. A missing score, or none in month 0, gives a NULL change.
    """
    bucket = F.pmod(F.xxhash64("patient_id"), F.lit(BUCKETS)).cast("int")
    return visits.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(
        partial(_advance, targets=targets, wait_ms=wait_ms),
        outputStructType=CHANGES,
        stateStructType="memory string",
        outputMode="append",
        timeoutConf=GroupStateTimeout.ProcessingTimeTimeout,
    )


def _advance(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, targets: tuple[str, ...], wait_ms: int
) -> Iterator[pd.DataFrame]:
    """The patients of a bucket. Those whose time limit has passed and that sent nothing are served too."""
    kept = json.loads(state.get[0]) if state.exists else {}
    now, met, rows = state.getCurrentProcessingTimeMs(), {}, []
    if not state.hasTimedOut:
        for batch in batches:
            for patient, visit_id, month, scores in zip(batch["patient_id"], batch["visit_id"], batch["visit_month"], batch["scores"]):
                if patient not in met:
                    memory = kept.setdefault(str(patient), {"base": None, "seen": [], "held": [], "since": None})
                    met[patient] = memory, set(memory["seen"]), memory["held"]
                memory, seen, ready = met[patient]
                if month in seen:
                    continue
                seen.add(int(month))
                scores = [None if s is None or s != s else int(s) for s in scores]
                ready.append([visit_id, int(month), scores])
                if month == 0:
                    memory["base"] = scores
    for patient, (memory, seen, ready) in met.items():
        memory["seen"] = sorted(seen)
        if memory["base"] is not None:
            memory["held"], memory["since"] = [], None
            rows += _rows(int(patient), ready, memory["base"], targets)
        elif ready:
            # the time limit starts with the first visit held, not with the last record
            memory["since"] = memory["since"] or now
    unknown, waiting = [None] * len(targets), []
    for patient, memory in kept.items():
        if not memory["held"]:
            continue
        if memory["since"] + wait_ms < now and int(patient) not in met:
            rows += _rows(int(patient), memory["held"], unknown, targets)
            memory["held"], memory["since"] = [], None
        else:
            waiting.append(memory["since"])
    if rows:
        out = pd.DataFrame(rows, columns=["visit_id", "patient_id", "visit_month", "target", "change"])
        yield out.astype({"patient_id": "int64", "visit_month": "int32", "change": "Int32"})
    state.update((json.dumps(kept),))
    if waiting:
        state.setTimeoutDuration(max(1, min(waiting) + wait_ms - now))


def _rows(patient: int, visits: list, base: list, targets: tuple[str, ...]) -> list[tuple]:
    return [
        (visit_id, patient, month, t, None if s is None or b is None else s - b)
        for visit_id, month, scores in visits
        for t, s, b in zip(targets, scores, base)
    ]


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what has arrived and stop; a rerun goes on where this one ended.

    A time limit asks for batches without data for ever, so that a run of this
    kind would not end. It makes none: limits that have passed are served by the
    batches of the next run.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        score.run_available(stream, sink, checkpoint)
    finally:
        conf.set(name, before)
