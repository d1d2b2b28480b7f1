"""Structured Streaming over ingested rows: exactly-once edges, counts per window, symbols by last write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from srcloom.operators.lookup import latest_symbols


def distinct_stream(rows: DataFrame, key: list[str], delay: str = "1 day") -> DataFrame:
    """Rows of a stream once per key; repeats later than the delay may come again, so state stays bounded."""
    return rows.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(key)


def window_counts(rows: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(repo_id, starts_at, n) per repository and tumbling window of ingest time; a window is final when its delay is over."""
    g = rows.withWatermark("ingested_at", delay).groupBy("repo_id", F.window("ingested_at", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("repo_id", F.col("w.start").alias("starts_at"), "n")


#: Parts of a merged table; a batch rewrites those its repositories fall into.
PARTS = 64
_PART = f"CAST(pmod(xxhash64(coalesce(repo_id, '')), {PARTS}) AS INT)"


def upsert_symbols(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of symbol rows into the table at folder; of a symbol the latest row counts.

    The table has PARTS parts by repository.  A batch writes a new version of the parts it
    has rows for; the version before it stays for readers and for a batch that is run
    again, which writes the same version again, and older ones are removed.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("part", F.expr(_PART))
        touched = [r.part for r in new.select("part").distinct().collect()]  # at most PARTS
        before = _newest(spark, folder, touched, batch_id)
        rows = new if not before else new.unionByName(spark.read.option("basePath", folder).parquet(*before.values()).select(*new.columns))
        keep = rows.groupBy("part", "symbol_name", "repo_id", "file_path").agg(F.max(F.struct("ingested_at", "start_line", "kind")).alias("m"))
        merged = keep.select("symbol_name", "repo_id", "file_path", "m.start_line", "m.kind", "m.ingested_at", "part", F.lit(batch_id).alias("v"))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "v").parquet(folder)
        for part, path in before.items():
            for version in _versions(spark, f"{folder}/part={part}"):
                if version < int(path.rpartition("=")[2]):
                    _system(spark, folder).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part={part}/v={version}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _system(spark: SparkSession, folder: str):
    return spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, part: str) -> list[int]:
    path, system = spark._jvm.org.apache.hadoop.fs.Path(part), _system(spark, part)
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    return [int(n[2:]) for n in names if n.startswith("v=")]


def _newest(spark: SparkSession, folder: str, parts: list[int], below: int | None = None) -> dict[int, str]:
    """Folder of the newest version of each part that has one, below a batch if one is given."""
    found = {p: [v for v in _versions(spark, f"{folder}/part={p}") if below is None or v < below] for p in parts}
    return {p: f"{folder}/part={p}/v={max(vs)}" for p, vs in found.items() if vs}


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The merged table as it stands; None if nothing was merged yet."""
    newest = _newest(spark, folder, list(range(PARTS)))
    return spark.read.option("basePath", folder).parquet(*newest.values()).drop("part", "v") if newest else None


__all__ = ["current", "distinct_stream", "latest_symbols", "upsert_symbols", "window_counts"]
