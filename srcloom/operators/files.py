"""Whole files put together again from their overlapping pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffix(path: Column) -> Column:
    """Last suffix of the file name without its dot, lower case."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def assemble(chunks: DataFrame, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(repo_id, file_path, text): one row per file with content, from its pieces.

    Pieces start at line starts and overlap, so of each piece only the lines before the
    next piece's start_line are taken and the last piece is taken whole.  Repeated rows
    and second ingests collapse; of different contents at one start_line the greatest
    counts.  Rows with null content, path or start_line are left out; a null repo_id is a
    repository of its own.  Repeated rows collapse before the shuffle, so a file that was
    ingested many times doesn't gather its copies in one task.
    """
    rows = chunks.where(F.col("content").isNotNull() & F.col("file_path").isNotNull() & F.col("start_line").isNotNull())
    if suffixes:
        rows = rows.where(suffix(F.col("file_path")).isin(*suffixes))
    pieces = rows.groupBy("repo_id", "file_path").agg(F.sort_array(F.collect_set(F.struct("start_line", "content"))).alias("ps"))
    text = F.expr(r"""array_join(transform(ps, (p, i) -> CASE
        WHEN i = size(ps) - 1 THEN p.content
        WHEN ps[i + 1].start_line > p.start_line THEN concat(substring_index(p.content, '\n', ps[i + 1].start_line - p.start_line), '\n')
        ELSE '' END), '')""")
    return pieces.select("repo_id", "file_path", text.alias("text"))
