"""Scoring visits with fitted models, from tables or from arriving records."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from visitloom.config import SCORE_THRESHOLDS
from visitloom.functions.scalar import call_at_threshold, cents, from_cents, medication_dummies

# Tasks carry this module's helpers with them, so workers need not import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Columns that stand before the contract in every feature vector.
EXTRA = ["visit_month", "num_prot_pep", "num_prot", "num_pept", "med_on", "med_unknown"]


def add_dummies(df: DataFrame, med: str = "med") -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in medication_dummies(med).items()])


def score_targets(
    rows: DataFrame, models: dict, keep: list[str], thresholds: dict = SCORE_THRESHOLDS
) -> DataFrame:
    """(keep..., target, p, pred): every model over the same vectors in one pass."""
    out = rows
    for target, model in models.items():
        scored = model.transform(out)
        drop = [c for c in ("rawPrediction", "probability", "prediction") if c in scored.columns]
        out = scored.withColumn(f"_p_{target}", vector_to_array("probability")[1]).drop(*drop)
    long = out.select(
        *keep,
        F.inline(
            F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_p_{t}").alias("p")) for t in models])
        ),
    )
    return long.withColumn("pred", call_at_threshold("target", "p", thresholds))


def record_vectors(records: DataFrame, contract: DataFrame) -> DataFrame:
    """Vectors of self-contained records, row by row.

    ``records`` has (visit_id, patient_id, visit_month, med, fields) where
    ``fields`` maps names to text. The contract (pos, feature, kind) says which
    features count and of which kind they are; its list is sent to the tasks, which
    look up the names that a record has, not those of the contract.
    No row needs another one, so this also runs on a stream.
    """
    listed = [tuple(r) for r in contract.select("feature", "kind").orderBy("pos", "feature", "kind").collect()]
    width, kinds = len(listed), ["protein", "peptide"]
    places: dict[str, list[int]] = {}
    for i, (feature, _) in enumerate(listed):
        if feature is not None:
            places.setdefault(feature, []).append(i)
    names = pa.array(list(places), pa.string())
    # the positions of each name one after the other
    times = np.array([len(own) for own in places.values()], np.int64)
    first, order = np.cumsum(times) - times, np.array([i for own in places.values() for i in own], np.int64)
    of_kind = {kind: np.array([k == kind for _, k in listed], bool) for kind in kinds}
    keep = ["visit_id", "patient_id", "visit_month", "med"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys, values = batch.column(len(keep)), batch.column(len(keep) + 1)
            row = np.repeat(np.arange(n), np.asarray(keys.value_lengths().fill_null(0)))
            name = np.asarray(pc.index_in(keys.flatten(), names).fill_null(-1))
            value = np.asarray(values.flatten().fill_null(0.0))
            known = np.flatnonzero(name >= 0)
            # of a name that comes twice the first counts
            known = known[np.sort(np.unique(row[known] * max(1, len(names)) + name[known], return_index=True)[1])]
            known = known[value[known] != 0]
            many = times[name[known]]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[name[known]], many)
            row, pos, value = np.repeat(row[known], many), order[at], np.repeat(value[known], many)
            sort = np.lexsort((pos, row))
            row, pos, value = row[sort], pos[sort], value[sort]

            def lists(some, of) -> pa.ListArray:
                ends = np.append(0, np.bincount(row[some], minlength=n).cumsum()).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(of[some]))

            whole = np.ones(len(row), bool)
            vector = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)), lists(whole, pos.astype(np.int32)), lists(whole, value)]
            vector = pa.StructArray.from_arrays(vector, ["type", "size", "indices", "values"])
            sums = [lists(whole, value), *(lists(of_kind[kind][pos], value) for kind in kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], vector, *sums], [*keep, "_cells", "_all", *kinds])

    read = records.select(
        *keep, F.map_keys("fields").alias("_keys"),
        F.transform(F.map_values("fields"), lambda v: v.try_cast("double")).alias("_values"),
    )
    schema = records.select(*keep).schema.add("_cells", VectorUDT())
    for c in ("_all", *kinds):
        schema = schema.add(c, ArrayType(DoubleType()))
    with_cells = read.mapInArrow(cells, schema)

    # the totals go over the values that are there
    def total(part: str):
        zero = F.lit(0).cast("bigint")
        return from_cents(F.aggregate(part, zero, lambda acc, v: acc + cents(v)))

    full = add_dummies(
        with_cells.select(
            *keep, F.col("_cells").alias("_cells", metadata={"ml_attr": {"num_attrs": width}}),
            total("_all").alias("num_prot_pep"),
            total("protein").alias("num_prot"),
            total("peptide").alias("num_pept"),
        )
    )
    # made of the values that are there, and as sparse
    unknown = F.raise_error(F.lit("NULL value in a feature vector")).cast("double")
    extra = [F.coalesce(F.col(c).cast("double"), unknown).alias(f"_{c}") for c in EXTRA]
    whole = VectorAssembler(inputCols=[*(f"_{c}" for c in EXTRA), "_cells"], outputCol="features", handleInvalid="keep")
    return whole.transform(full.select("*", *extra)).drop("_cells", *(f"_{c}" for c in EXTRA))
