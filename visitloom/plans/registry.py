"""Query registry: a name, a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Oracle-side definitions of the clinic frames, as DuckDB common table expressions.
_MONTHS = """
  SELECT o_orderkey, o_custkey AS patient_id, o_orderstatus, o_totalprice,
         (year(o_orderdate)*12+month(o_orderdate))
         - min(year(o_orderdate)*12+month(o_orderdate)) OVER (PARTITION BY o_custkey) AS visit_month
  FROM orders"""

VIEWS = {
    "visits": f"""
WITH o AS ({_MONTHS}),
l AS (
  SELECT l_orderkey, min(l_quantity) AS q, min(l_extendedprice) AS p, max(l_tax) AS tx
  FROM lineitem GROUP BY l_orderkey)
SELECT concat(cast(patient_id AS varchar), '_', cast(visit_month AS varchar)) AS visit_id,
       patient_id, cast(visit_month AS int) AS visit_month,
       cast(floor(max(o_totalprice)/15000*(patient_id % 5 + 1)/5) AS int) AS updrs_1,
       cast(floor(min(q)*(patient_id % 5 + 1)/5) AS int) AS updrs_2,
       cast(floor(min(p)/1500*(patient_id % 5 + 1)/5) AS int) AS updrs_3,
       cast(max(CASE WHEN o_orderstatus <> 'F' THEN round(tx*100) END) AS int) AS updrs_4,
       max(CASE o_orderstatus WHEN 'F' THEN 'On' WHEN 'O' THEN 'Off' END) AS med
FROM o LEFT JOIN l ON l_orderkey = o_orderkey
GROUP BY patient_id, visit_month""",
    "proteins": f"""
WITH o AS ({_MONTHS})
SELECT concat(cast(patient_id AS varchar), '_', cast(visit_month AS varchar)) AS visit_id,
       cast(visit_month AS int) AS visit_month, patient_id, p_brand AS UniProt,
       cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) AS NPX
FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
GROUP BY ALL""",
    "peptides": f"""
WITH o AS ({_MONTHS})
SELECT concat(cast(patient_id AS varchar), '_', cast(visit_month AS varchar)) AS visit_id,
       p_brand AS UniProt, p_type AS Peptide,
       cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS PeptideAbundance
FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
GROUP BY ALL""",
    "feats": """
SELECT visit_id, 'protein' AS kind, UniProt AS feature, NPX AS value FROM proteins
UNION ALL
SELECT visit_id, 'peptide', Peptide || '_' || UniProt, PeptideAbundance FROM peptides
WHERE visit_id IN (SELECT visit_id FROM proteins)""",
    # visits as (visit, target, score) rows, NULL scores kept
    "scores": """
SELECT visit_id, patient_id, visit_month, med, target, score FROM (
  SELECT visit_id, patient_id, visit_month, med, 'updrs_1' AS target, updrs_1 AS score FROM visits
  UNION ALL SELECT visit_id, patient_id, visit_month, med, 'updrs_2', updrs_2 FROM visits
  UNION ALL SELECT visit_id, patient_id, visit_month, med, 'updrs_3', updrs_3 FROM visits
  UNION ALL SELECT visit_id, patient_id, visit_month, med, 'updrs_4', updrs_4 FROM visits)""",
    # scored visits of the first three targets with label and pseudo-probability
    "scored": """
SELECT visit_id, patient_id, visit_month, target,
       CASE WHEN score <= CASE target WHEN 'updrs_1' THEN 10 WHEN 'updrs_2' THEN 12 ELSE 32 END
            THEN 0 ELSE 1 END AS label,
       cast(concat('0x', substr(md5(concat(target, ':', visit_id)),1,7)) AS bigint)/268435455.0 AS p
FROM scores WHERE target <> 'updrs_4' AND score IS NOT NULL""",
}
_NEEDS = {
    "feats": ("proteins", "peptides"),
    "scores": ("visits",),
    "scored": ("visits", "scores"),
}


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views and what they need."""
    wanted: list[str] = []
    for name in names:
        for n in (*_NEEDS.get(name, ()), name):
            if n not in wanted:
                wanted.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register a query. ``sql`` may start with ``, x AS (...)`` to add views."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (with_views(*views) + "\n" if views else "") + sql.strip()
        return fn

    return add
