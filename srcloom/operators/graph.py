"""Bounded breadth-first search over file edges, for many starts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.runtime import cut


def distinct_edges(edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Edges once each; rows without a source or target are no edges."""
    e = edges.where("source_file IS NOT NULL AND target_file IS NOT NULL")
    if edge_type:
        e = e.where(F.col("edge_type") == edge_type)
    return e.select("repo_id", "source_file", "target_file", "edge_type").distinct()


def nodes(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Endpoints of edges and the files, once each."""
    ends = edges.select("repo_id", F.explode(F.array("source_file", "target_file")).alias("node")).where("node IS NOT NULL")
    if files is not None:
        ends = ends.unionByName(files.where("file_path IS NOT NULL").select("repo_id", F.col("file_path").alias("node")))
    return ends.distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int = 3, reverse: bool = True) -> DataFrame:
    """(repo_id, start, node, depth): files within depth of each start (repo_id, start), at the least positive depth.

    reverse follows edges from target to source (dependents).  A start on a cycle is its
    own result at the cycle's length.  depth <= 0 gives no rows.  Every level is one join
    with the edges and one with what was seen before; from the second on a level is written
    and read again, so that the plan of a level doesn't hold those before it, and the search
    ends at the first empty one.
    """
    a, b = ("target_file", "source_file") if reverse else ("source_file", "target_file")
    step = edges.select("repo_id", F.col(a).alias("at"), F.col(b).alias("node")).distinct()
    frontier = starts.select("repo_id", "start", F.col("start").alias("at")).distinct()
    seen = None
    if depth > 1:
        step = cut(step)
    for level in range(1, depth + 1):
        found = frontier.join(step, ["repo_id", "at"]).select("repo_id", "start", "node").distinct()
        if seen is not None:
            found = found.join(seen.select("repo_id", "start", "node"), ["repo_id", "start", "node"], "left_anti")
        found = found.withColumn("depth", F.lit(level))
        if depth > 1:
            found = cut(found)
            if found.isEmpty():
                break
        seen = found if seen is None else seen.unionByName(found)
        frontier = found.select("repo_id", "start", F.col("node").alias("at"))
    if depth <= 0:
        return starts.select("repo_id", "start", F.col("start").alias("node"), F.lit(0).alias("depth")).limit(0)
    return found if seen is None else seen


def in_order(found: DataFrame) -> DataFrame:
    """reach()'s rows nearest first, ties by path."""
    return found.orderBy("repo_id", "start", "depth", "node")
