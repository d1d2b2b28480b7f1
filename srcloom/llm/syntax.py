"""Source files that do not parse, by token pairs, nesting and statement productions.

Every file is lexed once.  Of a file's tokens the rows that can show a fault go on: its
distinct adjacent pairs, its distinct steps between clauses of a statement, the brackets
of each line that do not close on it, and the statements whose productions failed.  Pairs
and steps are anti-joined with those the language's grammar permits, nesting is checked
by window functions over a file's brackets; statements are reduced window by window
(srcloom.llm.python_lines, srcloom.llm.lexers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm.files import SUFFIX_LANGUAGE, assemble, suffix
from srcloom.llm.grammar import permissible
from srcloom.llm.lexers import LEXERS
from srcloom.llm.python_lines import CLASS_NAMES, lex_python
from srcloom.runtime import cut

_CLOSES = {"PR": "PL", "BR": "BL", "CR": "CL", "OR": "OL", "GR": "GL"}
_OPENS = set(_CLOSES.values())
#: What a clause can follow in its chain.
CHAIN_STEPS = (
    "if>elif if>else elif>elif elif>else for>else while>else try>except try>finally except>except except>else except>finally else>finally try>catch catch>finally else>other except>other finally>other catch>other if>other elif>other for>other while>other"
).split()

SUFFIXES = ("py", *LEXERS)
PAIR, STEP, NEST, FAULT = range(4)
_ROWS = "repo_id string, file_path string, kind tinyint, seq int, pos int, a int, b int, line int"


def _vocabulary() -> list[str]:
    """Every word a row can hold: token classes by language, clause heads and faults, in a fixed order."""
    words = ["other"]
    for language in ("python", "json", "script"):
        words += sorted({f"{language} {c}" for pair in permissible(language) for c in pair} | {f"{language} {c}" for c in (*_CLOSES, *_OPENS)})
    words += sorted({f"clause {c}" for step in CHAIN_STEPS for c in step.split(">")})
    return words + ["clause none", *FAULTS]


#: Faults a lexer can name.
FAULTS = (
    "character or unfinished literal", "field of a formatted string", "statement", "tabs and spaces", "dedent to no outer level", "character or literal", "place of a value", "import without a source", "type", "declaration", "class",
    "unfinished string", "unfinished template", "number", "element", "operand <", "character", "body of a declaration", "assignment target", "constant without a value",
)
WORDS = _vocabulary()
_NUMBER = {w: n for n, w in enumerate(WORDS)}
_PYTHON = np.array([_NUMBER.get(f"python {c}", 0) for c in CLASS_NAMES], dtype=np.int32)


def _residue(tokens: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Brackets that are left when every line's own pairs are taken out."""
    left: list[tuple[str, int]] = []
    for c, line in tokens:
        if c in _OPENS:
            left.append((c, line))
        elif c in _CLOSES:
            if left and left[-1] == (_CLOSES[c], line):
                left.pop()
            else:
                left.append((c, line))
    return left


def _python_rows(texts: list[str]) -> list[np.ndarray]:
    """Columns file, kind, seq, pos, a, b, line of Python files."""
    pairs, brackets, chains, wrong = lex_python(texts)
    n, m = len(pairs[0]), len(brackets[0])
    one = (pairs[1] == 1) & (_PYTHON[pairs[2]] == _NUMBER["python END"])  # START END: an empty file
    steps = {}
    for k in range(1, len(chains)):
        (f, c, _, before, _), (g, d, _, head, line) = chains[k - 1], chains[k]
        if (f, c) == (g, d):
            steps.setdefault((f, _NUMBER.get(f"clause {before}", 0), _NUMBER.get(f"clause {head}", 0)), line)
    few = np.array([(f, STEP, 0, 0, a, b, line) for (f, a, b), line in steps.items()] + [(f, FAULT, 0, 0, _NUMBER[what], 0, line) for f, what, line in wrong], dtype=np.int64).reshape(-1, 7)
    zero = np.zeros(m, dtype=np.int64)
    rows = [
        np.stack([pairs[0], np.full(n, PAIR), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), _PYTHON[pairs[1]], _PYTHON[pairs[2]], pairs[3]])[:, ~one],
        np.stack([brackets[0], zero + NEST, zero, np.arange(m), _PYTHON[brackets[1]], zero, brackets[2]]),
        few.T,
    ]
    return list(np.concatenate(rows, axis=1))


def _other_rows(texts: list[str], suffixes: list[str]) -> list[np.ndarray]:
    """The same of files of the other languages."""
    rows: list[tuple[int, ...]] = []
    for n, (text, suffix_) in enumerate(zip(texts, suffixes, strict=True)):
        lexer, language = LEXERS[suffix_]
        sequences, chains, wrong = lexer(text, suffix_)
        pairs: dict[tuple[str, str], int] = {}
        for k, tokens in enumerate(sequences):
            classes, lines = zip(*tokens, strict=True)
            for pair, at in zip(zip(classes, classes[1:], strict=False), lines[1:], strict=False):
                if pair not in pairs:
                    pairs[pair] = at
            inner = tokens[1:-1] if classes[0] == "PL" else tokens
            rows += [(n, NEST, k, i, _NUMBER[f"{language} {c}"], 0, at) for i, (c, at) in enumerate(_residue(inner))]
        number = lambda c, language=language: _NUMBER.get(f"{language} {c}", 0)
        rows += [(n, PAIR, 0, 0, number(x), number(y), at) for (x, y), at in pairs.items() if (x, y) != ("START", "END") or language == "json"]
        steps: dict[tuple[str, str], int] = {}
        for chain in chains:
            for (before, _), (head, at) in zip(chain, chain[1:], strict=False):
                steps.setdefault((before, head), at)
        rows += [(n, STEP, 0, 0, _NUMBER.get(f"clause {x}", 0), _NUMBER.get(f"clause {y}", 0), at) for (x, y), at in steps.items()]
        rows += [(n, FAULT, 0, 0, _NUMBER[what], 0, at) for what, at in wrong]
    return list(np.array(rows, dtype=np.int64).reshape(-1, 7).T)


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int8(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    for batch in batches:
        paths = batch.column(1).to_pylist()
        ends = [p.rpartition(".")[2].lower() for p in paths]
        python = [i for i, e in enumerate(ends) if e == "py"]
        others = [i for i, e in enumerate(ends) if e != "py"]
        for chosen in [python[i : i + 64] for i in range(0, len(python), 64)] + [others[i : i + 64] for i in range(0, len(others), 64)]:
            take = pa.array(chosen, pa.int32())
            part = batch.take(take)
            texts = part.column(2).to_pylist()
            columns = _python_rows(texts) if ends[chosen[0]] == "py" else _other_rows(texts, [ends[i] for i in chosen])
            file, *rest = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0).take(file), part.column(1).take(file), *rest], ["repo_id", "file_path", "kind", "seq", "pos", "a", "b", "line"])


def faults(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, fault, line) of files (repo_id, file_path, text): every fault found."""
    spark = files.sparkSession
    allowed = [(PAIR, _NUMBER[f"{g} {a}"], _NUMBER[f"{g} {b}"]) for g in ("python", "json", "script") for a, b in sorted(permissible(g))]
    allowed += [(STEP, *(_NUMBER[f"clause {c}"] for c in step.split(">"))) for step in CHAIN_STEPS]
    table = spark.createDataFrame(allowed, "kind tinyint, a int, b int")
    rows = files.select("repo_id", "file_path", "text").mapInArrow(_lex, _ROWS)
    # What is permissible follows from the grammars alone: a few thousand rows.  Only what is not permitted, and open brackets, is written.
    rows = cut(rows.join(F.broadcast(table), ["kind", "a", "b"], "left_anti").select("repo_id", "file_path", "kind", "seq", "pos", "a", "b", "line"))
    key = ["repo_id", "file_path"]
    word = F.array(*[F.lit(w) for w in WORDS])
    where_ = Window.partitionBy(*key, "seq").orderBy("pos")
    nest = rows.where(F.col("kind") == NEST).withColumn("c", F.substring_index(word[F.col("a")], " ", -1))
    step = F.when(F.col("c").isin(*_OPENS), 1).otherwise(-1)
    nest = nest.withColumn("after", F.sum(step).over(where_)).withColumn("level", F.when(step == 1, F.col("after")).otherwise(F.col("after") + 1))
    level = Window.partitionBy(*key, "seq", "level").orderBy("pos")
    opener = F.create_map(*[F.lit(x) for kv in _CLOSES.items() for x in kv])
    before, behind = F.lag("c").over(level), F.lead("c").over(level)
    wrong = F.when(F.col("c").isin(*_CLOSES), (F.col("level") < 1) | before.isNull() | (before != opener[F.col("c")])).otherwise(behind.isNull())
    nest = nest.withColumn("wrong", wrong).where("wrong").select(*key, F.concat(F.lit("nesting "), "c").alias("fault"), "line")
    other = F.when(F.col("kind") == FAULT, word[F.col("a")]).otherwise(F.concat(word[F.col("a")], F.lit(" before "), F.substring_index(word[F.col("b")], " ", -1)))
    return nest.unionByName(rows.where(F.col("kind") != NEST).select(*key, other.alias("fault"), "line"))


def check_files(chunks: DataFrame) -> DataFrame:
    """(repo_id, file_path, fault, line): the first fault of every file that does not parse.

    Files are the .py, .ts, .tsx, .js, .jsx and .json files of chunks, judged whole and by
    their suffix.  An empty or blank source file is valid, an empty JSON file is not.
    Null contents and paths are left out; repeated rows and second ingests count once.
    """
    found = faults(assemble(chunks, SUFFIXES))
    return found.groupBy("repo_id", "file_path").agg(F.min_by("fault", F.struct("line", "fault")).alias("fault"), F.min("line").alias("line"))


def rates(chunks: DataFrame) -> DataFrame:
    """(repo_id, language, n_files, n_invalid, rate) per repository and language of the suffix."""
    language = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    bad = check_files(chunks).select(F.col("repo_id").alias("r"), F.col("file_path").alias("p"), F.lit(1).alias("bad"))
    files = chunks.where("content IS NOT NULL AND start_line IS NOT NULL").where(suffix(F.col("file_path")).isin(*SUFFIXES)).select("repo_id", "file_path").distinct()
    both = files.join(bad, F.col("repo_id").eqNullSafe(F.col("r")) & (F.col("file_path") == F.col("p")), "left")
    return both.groupBy("repo_id", language[suffix(F.col("file_path"))].alias("language")).agg(
        F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_invalid"), F.round(F.count("bad") / F.count(F.lit(1)), 6).alias("rate")
    )
