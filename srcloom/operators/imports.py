"""Imports resolved to scanned files: candidates in order, first one that exists wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions.paths import directory

#: Suffixes tried, in this order.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx")


def _join(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.when(p != "", p) for p in parts])


def _first_existing(imports: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    key = ["repo_id", "source_file", "imported_module"]
    rows = imports.select(*key).distinct().select(*key, F.posexplode(candidates).alias("rank", "target_file"))
    known = files.select("repo_id", F.col("file_path").alias("target_file")).distinct()
    return rows.join(known, ["repo_id", "target_file"], "left_semi").groupBy(*key).agg(F.min_by("target_file", "rank").alias("target_file"))


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, source_file, imported_module, target_file) of the imports found among files (repo_id, file_path).

    Candidates: module and package beside the source, then module and package at the top;
    leading dots are dropped whatever their number.
    """
    path = F.translate(F.regexp_replace("imported_module", r"^\.+", ""), ".", "/")
    here = directory(F.col("source_file"))
    c = F.array(F.concat(_join(here, path), F.when(path != "", ".py").otherwise("/.py")), _join(here, path, F.lit("__init__.py")), F.concat(path, F.lit(".py")), _join(path, F.lit("__init__.py")))
    return _first_existing(imports.where("imported_module IS NOT NULL AND imported_module != ''"), c, files)


def normalise(path: Column) -> Column:
    """Path with . and .. folded; .. above the top is dropped."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_script(imports: DataFrame, files: DataFrame) -> DataFrame:
    """As resolve_python for relative TypeScript and JavaScript imports; a suffix of the module is replaced."""
    base = normalise(_join(directory(F.col("source_file")), F.col("imported_module")))
    stem = F.regexp_replace(base, r"(?<=[^/])\.[^./]+$", "")
    c = F.array(*[x for s in SCRIPT_SUFFIXES for x in (F.concat(stem, F.lit(s)), _join(base, F.lit("index" + s)))])
    return _first_existing(imports.where(F.col("imported_module").startswith(".")), c, files)
