"""Operators on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcloom.functions import paths as P
from srcloom.functions import text as T
from srcloom.functions.vectors import l2_normalize
from srcloom.operators import chunking, graph, imports, lookup, search, symbols
from srcloom.operators import impact as I
from srcloom.operators.hierarchy import descendants, hierarchy

EDGE = "repo_id string, source_file string, target_file string, edge_type string"


def edges(spark, pairs, kind="import", repo="r"):
    return spark.createDataFrame([(repo, a, b, kind) for a, b in pairs], EDGE)


def reach(spark, pairs, start, depth, reverse=True):
    starts = spark.createDataFrame([("r", start)], "repo_id string, start string")
    return {r.node: r.depth for r in graph.reach(edges(spark, pairs), starts, depth, reverse).collect()}


CHAIN = [("A", "B"), ("B", "C")]


@pytest.mark.parametrize(
    "pairs,start,depth,reverse,expected",
    [
        (CHAIN, "B", 1, True, {"A": 1}), (CHAIN, "C", 2, True, {"B": 1, "A": 2}), (CHAIN, "C", 1, True, {"B": 1}), (CHAIN, "A", 2, False, {"B": 1, "C": 2}),
        ([("B", "A"), ("C", "A"), ("D", "B"), ("D", "C")], "A", 3, True, {"B": 1, "C": 1, "D": 2}), (CHAIN, "X", 3, True, {}),
        ([("A", "B"), ("B", "A")], "A", 3, True, {"B": 1, "A": 2}), ([("A", "A"), ("B", "A")], "A", 3, True, {"A": 1, "B": 1}), (CHAIN, "C", 0, True, {}),
    ],
)
def test_reach(spark, pairs, start, depth, reverse, expected):
    assert reach(spark, pairs, start, depth, reverse) == expected


def test_edges_and_nodes(spark):
    e = edges(spark, [("X", "Y"), ("X", "Y"), (None, "Z"), ("W", None)])
    assert graph.distinct_edges(e).count() == 1
    assert {r.node for r in graph.nodes(e).collect()} == {"X", "Y", "Z", "W"}


@pytest.mark.parametrize("total,expected", [(1000, [(1, 21), (18, 21)]), (2000, [(1, 33), (30, 41), (38, 41)]), (150, [(1, 4)])])
def test_chunk_traces(spark, total, expected):
    text = ("x" * 49 + "\n") * (total // 50)
    files = spark.createDataFrame([("r", "f", text), ("r", "blank", " \n"), ("r", "null", None)], "repo_id string, file_path string, text string")
    got = chunking.chunk_files(files).where("file_path = 'f'").orderBy("chunk_no").collect()
    assert [(r.start_line, r.end_line) for r in got] == expected
    assert chunking.chunk_files(files).where("file_path != 'f'").isEmpty()


def test_chunks_cover_everything():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["a", "é ", "\n", " ", "word", "\n\n"]) for _ in range(rng.randrange(0, 900)))
        seen, before = set(), -1
        for a, b in chunking.chunk_spans(text, 50, 10):
            assert a > before and b > a and b - a <= 50
            before = a
            seen |= set(range(a, b))
        assert all(i in seen for i, c in enumerate(text) if not c.isspace())
    with pytest.raises(ValueError):
        list(chunking.chunk_spans("x", 0))


def test_blank_run_is_skipped():
    text = "a\n" + " " * 4000 + "\nb"
    assert all(text[a:b].strip() for a, b in chunking.chunk_spans(text))


def test_paths(spark):
    rows = ["a.py", "UPPER.PY", "x/__init__.py", "x/.x.json", ".env", "node_modules/a.py", "Build/a.py", "a/.git/b.py", "a.png", "noext", "b.tsx"]
    df = spark.createDataFrame([(r,) for r in rows], "p string").select("p", P.suffix(F.col("p")).alias("s"), (P.is_included(F.col("p")) & ~P.in_skipped_dir(F.col("p"))).alias("k"), P.language(F.col("p")).alias("l"))
    got = {r.p: r for r in df.collect()}
    assert [p for p in rows if got[p].k] == ["a.py", "UPPER.PY", "x/__init__.py", "x/.x.json", "Build/a.py", "b.tsx"]
    assert got["UPPER.PY"].l == "python" and got["b.tsx"].l == "typescript" and got["noext"].l == "unknown" and got[".env"].s == ""


def test_text(spark):
    df = spark.createDataFrame([(bytearray(b"a\r\nb\rc"),), (bytearray(b"\xff\x00"),), (bytearray(b"a\x00"),), (None,)], "c binary")
    assert [r[0] for r in df.select(T.load_text(F.col("c"))).collect()] == ["a\nb\nc", None, None, None]
    cited = lambda s: spark.range(1).select(T.cited(F.lit(s), F.lit(3))).first()[0]
    assert cited("[2][1] [2] [0] [99] [1, 2] [12345678901234567890123]") == [1, 2]
    flag = lambda s: spark.range(1).select(T.uncertainty(F.lit(s))).first()[0]
    assert flag("It is NOT ENOUGH.") == T.UNCERTAIN_NOTE and flag("All fine.") is None


def test_symbols(spark):
    text = "import os\nfrom . import x\n\nclass A:\n    def m(self):\n        pass\n\n@d\nasync def f():\n    pass\n"
    assert symbols.parse_python(text) == [("import", "os", 1), ("import", ".", 2), ("class", "A", 4), ("function", "m", 5), ("function", "f", 9)]
    assert ("function", "broken", 1) in symbols.parse_python("def broken(:\n")
    js = 'import a from "./a";\n\nfunction f() {}\nconst g = async (x) => x;\nclass B {}\n// function no() {}\nconst h = (1 + 2);\n'
    assert symbols.parse_script(js) == [("import", "./a", 1), ("function", "f", 3), ("function", "g", 4), ("class", "B", 5)]


def test_imports(spark):
    files = spark.createDataFrame([("r", p) for p in ("p/m.py", "m.py", "q/__init__.py", "p/__init__.py", "w/a.ts", "w/b/index.js")], "repo_id string, file_path string")
    raw = spark.createDataFrame([("r", "p/x.py", "m"), ("r", "p/x.py", "q"), ("r", "p/x.py", "none"), ("r", "p/__init__.py", "."), ("r", "w/c.ts", "./a.service"), ("r", "w/c.ts", "../w/b"), ("r", "w/c.ts", "pkg")], "repo_id string, source_file string, imported_module string")
    py = {(r.source_file, r.imported_module): r.target_file for r in imports.resolve_python(raw.where("source_file LIKE '%.py'"), files).collect()}
    assert py == {("p/x.py", "m"): "p/m.py", ("p/x.py", "q"): "q/__init__.py", ("p/__init__.py", "."): "p/__init__.py"}
    ts = {r.imported_module: r.target_file for r in imports.resolve_script(raw.where("source_file LIKE '%.ts'"), files).collect()}
    assert ts == {"./a.service": "w/a.ts", "../w/b": "w/b/index.js"}


def test_search(spark):
    eye = spark.createDataFrame([(f"c{i}", [1.0 * (i == j) * (5 if i % 2 else 100) for j in range(8)]) for i in range(5)] + [("zero", [0.0] * 8)], "chunk_id string, embedding array<float>")
    q = eye.where("chunk_id = 'c3'")
    got = search.top_k(eye, q, 3).collect()
    assert got[0].chunk_id == "c3" and abs(got[0].score - 1) < 1e-9 and [r.chunk_id for r in got[1:]] == ["c0", "c1"]
    assert search.top_k(eye, q, 50).count() == 6 and search.top_k(eye, q, 0).count() == 0 and search.top_k(eye.limit(0), q, 3).count() == 0
    assert eye.where("chunk_id = 'zero'").select(l2_normalize(F.col("embedding"))).first()[0] == [0.0] * 8


def test_batch_search_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    q = base.where("id < 30").withColumnRenamed("id", "query_id")
    got = {}
    for r in search.batch_top_k(base, q, 5, block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(30):
        assert [i for _, i in sorted(got[k])] == list(np.argsort(-(u @ u[k]), kind="stable")[:5])


def test_definitions(spark):
    rows = [("f", "r", "b.py", 3, "function"), ("f", "r", "a.py", 1, "reference"), ("g", "r", "z.py", 1, None), ("g", "r", "y.py", 2, "reference")]
    s = spark.createDataFrame(rows, "symbol_name string, repo_id string, file_path string, start_line int, kind string")
    got = {r.symbol_name: r for r in lookup.definitions(s).collect()}
    assert got["f"].defining_file == "b.py" and got["f"].references == ["a.py", "b.py"] and got["g"].defining_file == "y.py"
    assert [r.symbol_name for r in lookup.definitions(s, strict=True).collect()] == ["f"]


def test_last_write_wins(spark):
    s = spark.createDataFrame([("f", "r", "a", 1, "class", 1), ("f", "r", "a", 9, "function", 2), ("f", "r", "a", None, None, 0)], "symbol_name string, repo_id string, file_path string, start_line int, kind string, ingested_at int")
    assert [tuple(r) for r in lookup.latest_symbols(s).collect()] == [("f", "r", "a", 9, "function")]


def impact(spark, target, pairs, syms=(), near=()):
    e = edges(spark, pairs)
    s = spark.createDataFrame([(n, "r", f, 1, k) for n, f, k in syms], "symbol_name string, repo_id string, file_path string, start_line int, kind string")
    t = spark.createDataFrame([("r", target)], "repo_id string, target string")
    z = spark.createDataFrame([("r", target, f) for f in near], "repo_id string, target string, file_path string")
    return {r.file_path: (r.confidence, r.depth, r.bucket, r.reason) for r in I.impact(t, e, graph.nodes(e), s, z, depth=4).collect()}


def test_impact(spark):
    long = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E")]
    got = impact(spark, "E", long, near=["A", "S", "E"])
    assert got["D"][:3] == (0.95, 1, "high") and got["C"][:3] == (0.75, 2, "high") and got["B"][:3] == (0.5, 3, "medium")
    assert got["A"][:3] == (0.3, 4, "related"), "similarity never raises a far dependent"
    assert got["S"] == (0.35, 0, "related", "semantically related") and "E" not in got
    by_name = impact(spark, "fn", long, [("fn", "E", "function"), ("fn", "B", "reference"), ("fn", "X", None)])
    assert by_name["B"] == (0.7, 0, "high", "references symbol") and by_name["X"][0] == 0.7 and "E" not in by_name and by_name["D"][0] == 0.95
    assert impact(spark, "nothing", long) == {}
    assert impact(spark, "A", [("A", "B"), ("B", "A")])["A"][:2] == (0.75, 2)


def brute(pairs):
    parent = {}
    for a, b in pairs:
        if a is not None:
            parent.setdefault(a, None)
        if b is not None and a is not None:
            parent[b] = min(a, parent.get(b) or a)
        elif b is not None:
            parent.setdefault(b, None)
    out = {}
    for n in parent:
        path, at = [n], n
        while parent[at] is not None and len(path) <= len(parent) + 1:
            at = parent[at]
            path.append(at)
        out[n] = ("", -1, None) if parent[at] is not None else (at, len(path) - 1, path[::-1])
    return out


@pytest.mark.parametrize("shape", ["forest", "chain", "star", "cycle", "empty"])
def test_hierarchy(spark, shape):
    rng = random.Random(5)
    pairs = {
        "forest": [(f"n{rng.randrange(max(1, i // 2))}", f"n{i}") for i in range(1, 60)] + [(None, "n0"), ("lonely", None), ("n0", "n1"), ("n0", "n1")],
        "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)],
        "star": [("hub", f"n{i}") for i in range(40)],
        "cycle": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("s", "s"), ("s", "t"), ("x", "y")],
        "empty": [],
    }[shape]
    e = edges(spark, pairs, "reexport").withColumn("id", F.lit("clash"))
    tree = hierarchy(e)
    got = {r.file_path: (r.root_file, r.depth, r.path) for r in tree.collect()}
    assert got == brute(pairs)
    if shape == "forest":
        want = {(p[i], n, d - i) for n, (_, d, p) in brute(pairs).items() for i in range(d)}
        assert {(r.file_path, r.descendant, r.distance) for r in descendants(tree).collect()} == want


def test_hierarchy_keeps_repositories_apart(spark):
    e = edges(spark, [("a", "b")], "reexport", "r1").unionByName(edges(spark, [("b", "a")], "reexport", None))
    got = {(r.repo_id, r.file_path): r.root_file for r in hierarchy(e, with_paths=False).collect()}
    assert got == {("r1", "a"): "a", ("r1", "b"): "a", (None, "a"): "b", (None, "b"): "b"}


def test_top_k_counts_an_id_once(spark):
    rows = [(f"c{i}", [float(i), 1.0]) for i in range(6)] + [("c5", [5.0, 1.0])] * 4 + [("c1", [9.0, 0.1]), (None, [1.0, 0.0]), ("short", [1.0]), ("null", None), ("hole", [1.0, None]), ("zero", [0.0, 0.0])]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([([2.0, 0.0],)], "embedding array<float>")
    got = [(r.chunk_id, round(r.score, 4)) for r in search.top_k(v, q, 3).collect()]
    assert got == [("c1", 0.9999), ("c5", 0.9806), ("c4", 0.9701)]
    assert search.top_k(v, q, 0).isEmpty() and search.top_k(v, q.limit(0), 3).isEmpty() and search.top_k(v.limit(0), q, 3).isEmpty()
    assert search.top_k(v, q, 50).count() == 7
    with pytest.raises(ValueError):
        search.top_k(v, q, search.MOST_HITS + 1)


def test_reach_goes_deep_with_small_plans(spark):
    edges = spark.createDataFrame([("r", f"f{i + 1}", f"f{i}") for i in range(12)] + [("r", "f0", "f12")], "repo_id string, source_file string, target_file string")
    found = graph.reach(edges, spark.createDataFrame([("r", "f0")], "repo_id string, start string"), 40)
    assert {r.node: r.depth for r in found.collect()} == {**{f"f{i}": i for i in range(1, 13)}, "f0": 13}
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_script_imports_in_comments_are_none():
    from srcloom.operators.symbols import parse_script

    got = parse_script('/*\nimport { a } from "x";\n*/\nimport b from "y";\nconst s = `\nimport c from "z"\n`;\n')
    assert [x for x in got if x[0] == "import"] == [("import", "y", 4)]


def test_chunk_spans_of_odd_texts():
    def windows(text, size, overlap):  # the definition, searched anew at every step
        at = 0
        while at < len(text):
            end = min(at + size, len(text))
            last = text.rfind("\n", at + 1, end)
            end = last + 1 if end < len(text) and last > 0 else end
            blank = not text[at:end].strip()
            if not blank:
                yield at, end
            nxt = end - overlap
            first = text.find("\n", nxt, end) if nxt > 0 else -1
            nxt = first + 1 if first >= 0 else nxt
            at = end if blank or end - overlap <= at or end - overlap >= len(text) or nxt <= at else nxt

    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice("ab \n\n") for _ in range(rng.randrange(60)))
        size, overlap = rng.randrange(1, 14), rng.randrange(0, 6)
        want = list(windows(text, size, overlap)) if text.strip() else []
        assert list(chunking.chunk_spans(text, size, overlap)) == want, (text, size, overlap)
