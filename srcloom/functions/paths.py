"""Path predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pruned directories, kept suffixes, languages by suffix.
SKIP_DIRS = (".git", "node_modules", "dist", "build", "__pycache__", ".venv", "venv", ".env", "coverage", ".next", ".nuxt", "target", "out", "bin", "obj", ".idea", ".vscode")
INCLUDE_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", ".md", ".txt", ".yaml", ".yml", ".toml", ".json")
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".md": "markdown"}


def suffix(path: Column) -> Column:
    """Last suffix of the file name with its dot, lower case; empty for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_included(path: Column) -> Column:
    return suffix(path).isin(*INCLUDE_SUFFIXES)


def in_skipped_dir(path: Column) -> Column:
    """Whether any directory of a relative path is skip-listed or hidden; case counts."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*SKIP_DIRS) | p.startswith("."))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[suffix(path)], F.lit("unknown"))


def relative(path: Column, root: str) -> Column:
    """Path below root; one that lies outside stays as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def directory(path: Column) -> Column:
    """Directory of a relative path, empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
