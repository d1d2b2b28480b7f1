"""End to end: a tree is indexed and asked."""

import pytest
from pyspark.sql import functions as F

from srcloom.engine import Engine
from srcloom.sources.repo import load_text, walk
from srcloom.store import UnknownRepository
from srcloom.streaming.ingest import current, distinct_stream, upsert_symbols, window_counts


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    files = {
        "pkg/__init__.py": "", "pkg/core.py": "import os\n\ndef charge(order):\n    return order\n", "pkg/api.py": "from pkg.core import charge\n\nclass Api:\n    def pay(self):\n        return charge(1)\n",
        "app.py": "import pkg.api\n", "web/main.ts": 'import { x } from "./util";\nexport function main() { return x; }\n', "web/util.ts": "export const x = () => 1;\n",
        "node_modules/skip.py": "x = 1\n", ".git/skip.py": "x = 1\n", "logo.png": "x", "README.md": "# Demo\n\nHow to charge an order.\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.py").write_bytes(b"\xff\x00")
    return root


def test_walk_and_load(tree):
    names = list(walk(str(tree)))
    assert "pkg/__init__.py" in names and "bad.py" in names and not any("skip" in n or "png" in n for n in names)
    assert load_text(str(tree / "bad.py")) is None and load_text(str(tree / "gone")) is None


def test_engine(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    with pytest.raises(UnknownRepository):
        engine.search("x", "demo").collect()
    row = engine.ingest(str(tree), "demo").first()
    assert (row.files_indexed, row.edges_in_graph) == (8, 3) and row.symbols_extracted == 5
    assert engine.ingest(str(tree), "demo").first() == row, "a second ingest replaces the first"
    assert engine.search("charge order", "demo", 3).count() == 3
    d = engine.definition("charge", "demo").first()
    assert (d.defining_file, d.start_line) == ("pkg/core.py", 3)
    with pytest.raises(LookupError):
        engine.definition("nothing", "demo")
    got = {r.file_path: r.confidence for r in engine.impact("charge", "demo").collect()}
    assert got["pkg/api.py"] == 0.95 and got["app.py"] == 0.75
    a = engine.ask("how to charge an order?", "demo").first()
    assert a.citations[0].relevance == "Cited as [1] in the answer" and a.uncertainty is None
    with pytest.raises(Exception, match="no such folder"):
        engine.ingest(str(tree / "missing"), "x").collect()


def test_streams(spark, tmp_path):
    schema = "symbol_name string, repo_id string, file_path string, start_line int, kind string, ingested_at timestamp"
    rows = [("f", "r", "a", 1, "function", "2025-01-01 00:00:00"), ("f", "r", "a", 5, "function", "2025-01-02 00:00:00"), ("g", "r", "a", 2, "class", "2025-01-01 00:00:00")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ingested_at", F.to_timestamp("ingested_at")).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    upsert_symbols(stream(), out, str(tmp_path / "ck")).awaitTermination()
    assert {(r.symbol_name, r.start_line) for r in current(spark, out).collect()} == {("f", 5), ("g", 2)}
    spark.createDataFrame([("f", "r", "a", 9, "function", "2025-01-03 00:00:00")], schema.replace("timestamp", "string")).withColumn("ingested_at", F.to_timestamp("ingested_at")).write.mode("append").parquet(src)
    upsert_symbols(stream(), out, str(tmp_path / "ck")).awaitTermination()
    assert {(r.symbol_name, r.start_line) for r in current(spark, out).collect()} == {("f", 9), ("g", 2)}
    spark.createDataFrame([("f", "r", "a", 2, "function", "2024-01-03 00:00:00"), ("h", "q", "a", 2, "class", "2025-01-03 00:00:00")], schema.replace("timestamp", "string")).withColumn("ingested_at", F.to_timestamp("ingested_at")).write.mode("append").parquet(src)
    upsert_symbols(stream(), out, str(tmp_path / "ck")).awaitTermination()
    assert {(r.symbol_name, r.start_line) for r in current(spark, out).collect()} == {("f", 9), ("g", 2), ("h", 2)}
    kept = sorted(p.parent.name + p.name for p in (tmp_path / "out").glob("part=*/v=*"))
    assert len(kept) == 3, "of every part the newest version and the one before"
    for name, df in (("once", distinct_stream(stream(), ["symbol_name", "file_path"])), ("per_day", window_counts(stream()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("once").count() == 3 and spark.table("per_day").columns == ["repo_id", "starts_at", "n"]


def test_second_ingest_replaces_tables_that_become_empty(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.ingest(str(tree), "demo")
    engine.ingest(str(tree), "other")
    for f in list(tree.rglob("*.py")) + list(tree.rglob("*.ts")):
        f.unlink()
    row = engine.ingest(str(tree), "demo").first()
    assert (row.files_indexed, row.symbols_extracted, row.edges_in_graph) == (1, 0, 0)
    with pytest.raises(LookupError):
        engine.definition("charge", "demo")
    assert engine.store.read("edges", "demo").isEmpty() and engine.store.read("symbols", "demo").isEmpty()
    assert [r.file_path for r in engine.search("charge", "demo").collect()] == ["README.md"]
    assert engine.definition("charge", "other").count() == 1 and engine.store.read("edges", "other").count() == 3


def test_arguments_are_checked(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.ingest(str(tree), "demo")
    for call in (lambda: engine.search("x", "demo", -1), lambda: engine.search("x", "demo", 10**9), lambda: engine.impact("charge", "demo", 1000), lambda: engine.ask("x", "demo", "3")):
        with pytest.raises(ValueError, match="whole number"):
            call()
    assert engine.search("x", "demo", 0).isEmpty() and engine.health() == {"status": "ok"} and engine.dimension == 384


def test_command_line(spark, tree, tmp_path):
    from srcloom.__main__ import parser, run

    engine = Engine(spark, str(tmp_path / "store"))
    said = lambda *words: run(engine, parser().parse_args([str(tmp_path / "store"), *words]))
    assert "files_indexed: 8" in said("ingest", "demo", str(tree)) and said("health") == ["status: ok"]
    found = said("search", "demo", "charge order", "--top-k", "2")
    assert found[0].startswith("2 results") and len(found[1].rpartition(", ")[2]) == 5
    assert said("definition", "demo", "charge")[0] == "charge: function in pkg/core.py, line 3"
    impact = said("impact", "demo", "pkg/core.py", "--depth", "1")
    assert "   0.95 pkg/api.py: direct import" in impact and "Medium confidence" not in impact
    assert any("Cited as [1]" in x for x in said("ask", "demo", "how to charge?"))


def test_model_embedder(spark):
    import numpy as np

    from srcloom.operators.search import ModelEmbedder

    embedder = ModelEmbedder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), 2, "lengths")
    rows = spark.createDataFrame([(f"c{i:03}", "x" * i) for i in range(130)] + [("n", None)], "chunk_id string, text string")
    got = {r.chunk_id: list(r.embedding) for r in embedder(rows).collect()}
    assert embedder.dimension == 2 and got["c129"] == [129.0, 1.0] and got["n"] == [0.0, 1.0] and len(got) == 131


def test_deep_trees_are_walked_by_the_tasks(spark, tmp_path):
    from srcloom.sources.repo import register, shares

    files = {"a.py", "p/b.py", "p/q/c.py", "p/q/r/s/d.py", "x/y/e.md", "x/y/node_modules/no.py", "x/.git/no.py"}
    for f in files:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x = 1\n")
    got = shares(str(tmp_path))
    assert sorted(len(folders) for folders, _ in got) == [0, 1, 1] and sum(len(f) for _, f in got) == 2
    register(spark)
    rows = spark.read.format("repo").option("repo_id", "r").load(str(tmp_path))
    assert {r.file_path for r in rows.collect()} == {f for f in files if "no.py" not in f}
    empty = tmp_path / "empty"
    empty.mkdir()
    assert spark.read.format("repo").load(str(empty)).isEmpty()
