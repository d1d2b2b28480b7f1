"""Change impact: dependents, symbol references and similar files merged into ranked buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.operators.graph import reach
from srcloom.operators.lookup import definitions

#: Confidence by hops, of references and of similarity, and the buckets' bounds.
HOP_CONFIDENCE, FAR_CONFIDENCE, SYMBOL_CONFIDENCE, SIMILAR_CONFIDENCE = {1: 0.95, 2: 0.75, 3: 0.5}, 0.3, 0.7, 0.35
HIGH, MEDIUM, SIMILAR_CHUNKS = 0.7, 0.4, 5
#: Reasons of the signals.
DIRECT, TRANSITIVE, REFERENCE, SIMILAR = "direct import", "transitive import (%d hops)", "references symbol", "semantically related"


def hop_confidence(depth: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in HOP_CONFIDENCE.items() for x in kv])
    return F.coalesce(table[depth], F.lit(FAR_CONFIDENCE))


def hop_reason(depth: Column) -> Column:
    return F.when(depth == 1, DIRECT).otherwise(F.format_string(TRANSITIVE, depth))


def bucket(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("related")


def merge_signals(signals: DataFrame) -> DataFrame:
    """Best signal per (repo_id, target, file_path): the highest confidence, then the earlier signal."""
    best = signals.groupBy("repo_id", "target", "file_path").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "signal", "depth", "reason")).alias("m"))
    return best.select("repo_id", "target", "file_path", "m.reason", (-F.col("m.c")).alias("confidence"), "m.depth")


def impact(targets: DataFrame, edges: DataFrame, node_rows: DataFrame, symbols: DataFrame, similar: DataFrame | None = None, depth: int = 3) -> DataFrame:
    """(repo_id, target, file_path, reason, confidence, depth, bucket) for targets (repo_id, target).

    A target is a file if it is a node, else the name of a symbol.  edges and symbols are
    distinct rows, node_rows is (repo_id, node).  similar holds the files of the closest
    chunks per target, (repo_id, target, file_path); it adds files no other signal has.
    A target that is neither file nor symbol gives no graph rows.
    """
    t = targets.select("repo_id", "target").distinct()
    files = t.join(node_rows.select("repo_id", F.col("node").alias("target")), ["repo_id", "target"], "left_semi").withColumn("root", F.col("target"))
    names = t.join(files.select("repo_id", "target"), ["repo_id", "target"], "left_anti")
    defined = definitions(symbols, strict=True).select("repo_id", F.col("symbol_name").alias("target"), F.col("defining_file").alias("root"))
    roots = files.unionByName(names.join(defined, ["repo_id", "target"]))
    found = reach(edges, roots.select("repo_id", F.col("root").alias("start")), depth)
    graph = roots.join(found.withColumnRenamed("start", "root"), ["repo_id", "root"]).select(
        "repo_id", "target", F.col("node").alias("file_path"), hop_reason(F.col("depth")).alias("reason"), hop_confidence(F.col("depth")).alias("confidence"), "depth", F.lit(1).alias("signal")
    )
    refs = names.join(symbols.select("repo_id", F.col("symbol_name").alias("target"), "file_path").distinct(), ["repo_id", "target"]).join(roots, ["repo_id", "target"], "left")
    refs = refs.where(~F.col("file_path").eqNullSafe(F.col("root"))).select(
        "repo_id", "target", "file_path", F.lit(REFERENCE).alias("reason"), F.lit(SYMBOL_CONFIDENCE).alias("confidence"), F.lit(0).alias("depth"), F.lit(2).alias("signal")
    )
    merged = merge_signals(graph.unionByName(refs))
    if similar is not None:
        covered = merged.select("repo_id", "target", "file_path").unionByName(roots.select("repo_id", "target", F.col("root").alias("file_path")))
        extra = similar.select("repo_id", "target", "file_path").distinct().join(covered, ["repo_id", "target", "file_path"], "left_anti")
        merged = merged.unionByName(extra.withColumns({"reason": F.lit(SIMILAR), "confidence": F.lit(SIMILAR_CONFIDENCE), "depth": F.lit(0)}).select(*merged.columns))
    return merged.withColumn("bucket", bucket(F.col("confidence")))
