"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.orphans import BLANK, find_orphans, orphan_report, references
from lectern.sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    rel = table(spark, folder, "relationships", "rel_id", "source", "target", "extracted_at")
    ent = table(spark, folder, "entities", "name", "arrived_at", "deleted_at")
    return find_orphans(references(rel, "rel_id", "extracted_at", ("source", "target"), "relationships"), ent)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).selectExpr("key AS rel_id", "ref_field", "reason").distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder))


def _key(c: str) -> str:
    return f"lower(regexp_replace({c}, '^{BLANK}|{BLANK}$', '', 'g'))"


_BASE = f"""
WITH r AS (
  SELECT DISTINCT rel_id, ref_field, k, extracted_at AS t FROM (
    SELECT rel_id, 'source' AS ref_field, {_key("source")} AS k, extracted_at FROM relationships
    UNION ALL SELECT rel_id, 'target', {_key("target")}, extracted_at FROM relationships) WHERE k <> ''
), e AS (
  SELECT DISTINCT {_key("name")} AS k, arrived_at AS a, deleted_at AS d FROM entities
), j AS (
  SELECT rel_id, ref_field, r.k, t, count(e.k) AS n,
         count(CASE WHEN a <= t AND (d IS NULL OR d > t) THEN 1 END) AS alive,
         count(CASE WHEN a <= t THEN 1 END) AS arrived
  FROM r LEFT JOIN e ON r.k = e.k GROUP BY rel_id, ref_field, r.k, t
), f AS (
  SELECT rel_id, ref_field, t, CASE WHEN n = 0 THEN 'missing' WHEN arrived > 0 THEN 'deleted' ELSE 'late' END AS reason FROM j WHERE alive = 0
)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _BASE + "SELECT DISTINCT rel_id, ref_field, reason FROM f",
    "p1_report": _BASE + "SELECT 'relationships' AS table_name, ref_field, strftime(t, '%Y-%m') AS month, reason, count(*) AS n_orphans FROM f GROUP BY ALL",
}
