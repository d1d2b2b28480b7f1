"""Queries of the hierarchy operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.operators.hierarchy import descendants, hierarchy
from srcloom.runtime import cut, table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "edges"), with_paths=False).select("repo_id", "file_path", "root_file", "depth")


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "edges")).withColumn("path", F.array_join("path", " > "))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(cut(hierarchy(table(spark, d, "edges"))))


_SQL = """WITH RECURSIVE l AS (
    SELECT repo_id, f, min(p) AS p FROM (
        SELECT repo_id, target_file AS f, source_file AS p FROM edges WHERE edge_type = 'reexport' AND target_file IS NOT NULL
        UNION ALL SELECT repo_id, source_file, NULL FROM edges WHERE edge_type = 'reexport' AND source_file IS NOT NULL) GROUP BY repo_id, f),
r AS (SELECT repo_id, f, f AS root, 0 AS depth, [f] AS path FROM l WHERE p IS NULL
    UNION ALL SELECT l.repo_id, l.f, r.root, r.depth + 1, list_append(r.path, l.f) FROM r JOIN l ON l.p = r.f AND l.repo_id IS NOT DISTINCT FROM r.repo_id)"""

QUERIES = {f.__name__: f for f in (p6_found, p6_hierarchy, p6_descendants)}
ORACLES = {
    "p6_found": _SQL + """ SELECT l.repo_id, l.f AS file_path, coalesce(r.root, '') AS root_file, CAST(coalesce(r.depth, -1) AS INTEGER) AS depth
        FROM l LEFT JOIN r ON l.f = r.f AND l.repo_id IS NOT DISTINCT FROM r.repo_id""",
    "p6_hierarchy": _SQL + """ SELECT l.repo_id, l.f AS file_path, coalesce(r.root, '') AS root_file, CAST(coalesce(r.depth, -1) AS INTEGER) AS depth,
        array_to_string(r.path, ' > ') AS path FROM l LEFT JOIN r ON l.f = r.f AND l.repo_id IS NOT DISTINCT FROM r.repo_id""",
    "p6_descendants": _SQL + """ SELECT repo_id, path[i] AS file_path, f AS descendant, CAST(depth - i + 1 AS INTEGER) AS distance
        FROM (SELECT *, unnest(range(1, len(path))) AS i FROM r)""",
}
