"""Point lookups, last-write-wins tables and definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFINING_KINDS = ("function", "class", "method")


def latest_symbols(symbols: DataFrame) -> DataFrame:
    """One row per (symbol_name, repo_id, file_path): the latest ingest, of it the greatest line and kind."""
    key = ["symbol_name", "repo_id", "file_path"]
    return symbols.groupBy(*key).agg(F.max(F.struct("ingested_at", "start_line", "kind")).alias("m")).select(*key, "m.start_line", "m.kind")


def find_symbol(symbols: DataFrame, repo_id: str, name: str) -> DataFrame:
    return latest_symbols(symbols.where((F.col("repo_id") == repo_id) & (F.col("symbol_name") == name)))


def definitions(symbols: DataFrame, strict: bool = False, kinds: bool = False) -> DataFrame:
    """(repo_id, symbol_name, defining_file, start_line, references) per symbol of last-write-wins rows.

    The definer is the smallest path of a function, class or method; without one, the
    smallest path of any row, or nothing if strict.  references are all files with the name.  With kinds
    the kind of the definer comes last.
    """
    ok = F.coalesce(F.col("kind").isin(*DEFINING_KINDS), F.lit(False))
    out = symbols.groupBy("repo_id", "symbol_name").agg(
        F.min(F.struct((~ok).alias("bad"), "file_path", "start_line", "kind")).alias("d"), F.array_sort(F.collect_set("file_path")).alias("references")
    )
    if strict:
        out = out.where("NOT d.bad")
    return out.select("repo_id", "symbol_name", F.col("d.file_path").alias("defining_file"), F.col("d.start_line").alias("start_line"), "references", *([F.col("d.kind").alias("kind")] if kinds else []))
