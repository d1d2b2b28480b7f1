"""Symbols and imports of source files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line patterns of definitions and imports.
PY_FUNCTION, PY_CLASS = r"^def\s+(\w+)\s*\(", r"^class\s+(\w+)"
PY_IMPORT = r"(?md)^(?:import|from)\s+([\w.]+)"
TS_FUNCTION = r"^\s*(?:export\s+)?(?:async\s+)?(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\()"
TS_CLASS = r"^\s*(?:export\s+)?class\s+(\w+)"
TS_IMPORT = r"(?:import|from)\s+['\"]([^'\"]+)['\"]"
PY_PRESCAN = r"(?md)^(?:def|class)\s+(\w+)"
TS_PRESCAN = r"(?md)^(?:export\s+)?(?:function|class|const|let|var)\s+(\w+)"


def _lines(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "file_path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def regex_symbols(files: DataFrame, python: bool) -> DataFrame:
    """(repo_id, file_path, symbol_name, kind, start_line) by line patterns, for files (repo_id, file_path, text).

    Python definitions count at the margin only.  start_line is the definition's own line.
    """
    f, c = (PY_FUNCTION, PY_CLASS) if python else (TS_FUNCTION, TS_CLASS)
    fn = F.regexp_extract("line", f, 1)
    if not python:
        fn = F.concat(fn, F.regexp_extract("line", f, 2))
    found = _lines(files).select("repo_id", "file_path", (F.col("pos") + 1).alias("start_line"), fn.alias("fn"), F.regexp_extract("line", c, 1).alias("cl"))
    name = F.when(F.col("fn") != "", F.col("fn")).otherwise(F.col("cl"))
    return found.where("fn != '' OR cl != ''").select("repo_id", "file_path", name.alias("symbol_name"), F.when(F.col("fn") != "", "function").otherwise("class").alias("kind"), "start_line")


def regex_imports(files: DataFrame, python: bool) -> DataFrame:
    """(repo_id, file_path, imported_module, is_relative), one row per import."""
    rows = files.select("repo_id", "file_path", F.explode(F.regexp_extract_all("text", F.lit(PY_IMPORT if python else TS_IMPORT), F.lit(1))).alias("imported_module"))
    return rows.withColumn("is_relative", F.col("imported_module").startswith("."))


def prescan(text: Column, language: Column) -> Column:
    """Distinct names defined in a file, in order; none for other languages."""
    script = F.regexp_extract_all(text, F.lit(TS_PRESCAN), F.lit(1))
    python = F.regexp_extract_all(text, F.lit(PY_PRESCAN), F.lit(1))
    return F.array_distinct(F.when(language == "python", python).when(language.isin("typescript", "javascript"), script).otherwise(F.array().cast("array<string>")))


def parse_python(text: str) -> list[tuple[str, str, int]]:
    """(what, name, line) of functions, classes and imports in source order; falls back to patterns if the text doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        out = []
        for what, pattern in (("function", PY_FUNCTION), ("class", PY_CLASS), ("import", r"^(?:import|from)\s+([\w.]+)")):
            out += [(what, m.group(1), text.count("\n", 0, m.start()) + 1) for m in re.finditer(pattern, text, re.M)]
        return out
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("function", node.name, node.lineno))
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, node.lineno))
        elif isinstance(node, ast.Import):
            out.append(("import", node.names[0].name, node.lineno))
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            out.append(("import", "." * node.level + (node.module or ""), node.lineno))
    return sorted(out, key=lambda x: x[2])


_SKIP = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_SCRIPT_DEF = re.compile(r"\bfunction\b\s*\*?\s*([\w$]+)|\bclass\s+([\w$]+)|\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;\n]+)?=\s*(?:async\b\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{]+)?=>|[\w$]+\s*=>)")
_SCRIPT_IMPORT = re.compile(r"^[ \t]*import\b[^;'\"]*['\"]([^'\"\n]+)['\"]", re.M)


def parse_script(text: str) -> list[tuple[str, str, int]]:
    """As parse_python, for TypeScript and JavaScript: literals and comments are masked, definitions found in the rest."""
    masked = _SKIP.sub(lambda m: re.sub(r"[^\n]", "_", m.group()), text)
    out = []
    for m in _SCRIPT_DEF.finditer(masked):
        name = m.group(1) or m.group(2) or m.group(3)
        out.append(("class" if m.group(2) else "function", name, text.count("\n", 0, m.start(m.lastindex)) + 1))
    # The source of an import is a literal, so imports are read from the text where the mask still shows the word.
    out += [("import", m.group(1), text.count("\n", 0, m.start()) + 1) for m in _SCRIPT_IMPORT.finditer(text) if masked[m.start() : m.end()].lstrip().startswith("import")]
    return sorted(out, key=lambda x: x[2])


def extract(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, what, name, line): one parse per file of files (repo_id, file_path, language, text).

    what is function, class or import.  Other languages and null texts give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, path, language, text in zip(pdf["repo_id"], pdf["file_path"], pdf["language"], pdf["text"], strict=True):
                out += [(repo, path, *x) for x in (parse_python if language == "python" else parse_script)(text)]
            yield pd.DataFrame(out, columns=["repo_id", "file_path", "what", "name", "line"])

    rows = files.where("text IS NOT NULL AND language IN ('python', 'typescript', 'javascript')").select("repo_id", "file_path", "language", "text")
    return rows.mapInPandas(run, "repo_id string, file_path string, what string, name string, line int")
