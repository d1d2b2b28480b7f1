"""Ingest, search, definition, impact, ask and health over a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.operators import answer as answers
from srcloom.functions.vectors import l2_normalize
from srcloom.operators import chunking, graph, imports, lookup, search, symbols
from srcloom.operators import impact as impacts
from srcloom.runtime import cut, ship
from srcloom.sources import repo
from srcloom.store import Store

Embedder = Callable[[DataFrame], DataFrame]
#: Most hops of an impact search; every one is a join.
MOST_DEPTH = 64


def _within(name: str, value: int, most: int) -> int:
    """A count as given by a caller; ValueError if it is none or out of range."""
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= most:
        raise ValueError(f"{name} must be a whole number from 0 to {most}")
    return value


class Engine:
    """The entry points.  embedder maps (chunk_id, text) to (chunk_id, embedding), backend a prompt to an answer."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, backend: Callable[[str], str] = answers.extractive_answer):
        ship(spark)
        repo.register(spark)
        self.spark, self.store, self.embedder, self.backend = spark, Store(spark, root), embedder or search.HashEmbedder(), backend

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    @property
    def dimension(self) -> int | None:
        """Numbers of a vector, as the embedder states them."""
        return getattr(self.embedder, "dimension", None)

    def ingest(self, folder: str, repo_id: str) -> DataFrame:
        """Index a source tree; one row of counts.  files_indexed counts walked files, symbols before dedup."""
        files = cut(self.spark.read.format("repo").option("repo_id", repo_id).load(folder))
        readable = files.where("text IS NOT NULL")
        parsed = cut(symbols.extract(readable))
        found = parsed.where("what != 'import'")
        self.store.replace("files", repo_id, files)
        last = found.groupBy("repo_id", "file_path", F.col("name").alias("symbol_name")).agg(F.max(F.struct("line", "what")).alias("m"))
        self.store.replace("symbols", repo_id, last.select("symbol_name", "repo_id", "file_path", F.col("m.line").alias("start_line"), F.col("m.what").alias("kind")))
        raw = parsed.where("what = 'import'").select("repo_id", F.col("file_path").alias("source_file"), F.col("name").alias("imported_module"))
        is_py = F.col("source_file").endswith(".py")
        edges = imports.resolve_python(raw.where(is_py), files).unionByName(imports.resolve_script(raw.where(~is_py), files))
        edges = cut(edges.select("repo_id", "source_file", "target_file", F.lit("import").alias("edge_type")).distinct())
        self.store.replace("edges", repo_id, edges)
        about = readable.select("repo_id", "file_path", "language", symbols.prescan(F.col("text"), F.col("language")).alias("symbols"))
        listed = raw.groupBy("repo_id", F.col("source_file").alias("file_path")).agg(F.array_sort(F.collect_set("imported_module")).alias("imports"))
        pieces = chunking.with_chunk_ids(chunking.chunk_files(readable))
        chunks = pieces.join(about, ["repo_id", "file_path"]).join(listed, ["repo_id", "file_path"], "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))
        chunks = cut(chunks)
        self.store.replace("chunks", repo_id, chunks)
        vectors = self.embedder(chunks.select("chunk_id", F.col("content").alias("text")))
        vectors = vectors.withColumn("embedding", l2_normalize(F.col("embedding")).cast("array<float>"))
        self.store.replace("vectors", repo_id, vectors)
        self.store.forget(repo_id)
        counts = [(files, "files_indexed"), (chunks, "chunks_indexed"), (found, "symbols_extracted"), (edges, "edges_in_graph")]
        return self.spark.createDataFrame([(repo_id, *[d.count() for d, _ in counts])], "repo_id string, " + ", ".join(f"{n} long" for _, n in counts))

    def _query(self, text: str) -> DataFrame:
        return self.embedder(self.spark.createDataFrame([("query", text)], "chunk_id string, text string"))

    def _hits(self, text: str, repo_id: str, k: int) -> DataFrame:
        self.store.require(repo_id)
        _within("top_k", k, search.MOST_HITS)
        return search.top_k(self.store.read("vectors", repo_id).select("chunk_id", "embedding"), self._query(text), k)

    def search(self, query: str, repo_id: str, top_k: int = 10) -> DataFrame:
        return search.with_chunks(self._hits(query, repo_id, top_k), self.store.read("chunks", repo_id)).orderBy(F.desc("score"), "chunk_id")

    def definition(self, symbol: str, repo_id: str) -> DataFrame:
        """One row; LookupError if the repository has no such symbol."""
        self.store.require(repo_id)
        rows = lookup.definitions(self.store.read("symbols", repo_id).where(F.col("symbol_name") == symbol), kinds=True)
        if rows.isEmpty():
            raise LookupError(symbol)
        return rows

    def impact(self, target: str, repo_id: str, depth: int = 3) -> DataFrame:
        self.store.require(repo_id)
        _within("depth", depth, MOST_DEPTH)
        targets = self.spark.createDataFrame([(repo_id, target)], "repo_id string, target string")
        edges, files = self.store.read("edges", repo_id), self.store.read("files", repo_id)
        hits = self._hits(target, repo_id, impacts.SIMILAR_CHUNKS)
        near = search.hit_rows(hits, self.store.read("chunks", repo_id)).select("repo_id", F.lit(target).alias("target"), "file_path")
        rows = impacts.impact(targets, edges, graph.nodes(edges, files), self.store.read("symbols", repo_id), near, depth)
        return rows.orderBy(F.desc("confidence"), "depth", "file_path")

    def ask(self, question: str, repo_id: str, top_k: int = 8) -> DataFrame:
        """(question, answer, uncertainty, citations); without hits the backend is not asked."""
        hits = self._hits(question, repo_id, top_k)
        rows = [r.asDict() for r in search.hit_rows(hits, self.store.read("chunks", repo_id)).orderBy(F.desc("score"), "chunk_id").collect()]  # at most top_k rows
        ranked = self.spark.createDataFrame(
            [(question, n, r["file_path"], r["start_line"], r["end_line"], r["content"]) for n, r in enumerate(rows, 1)],
            "question string, rank long, file_path string, start_line int, end_line int, content string",
        )
        prompts = answers.build_prompts(ranked) if rows else self.spark.createDataFrame([(question, 0, "")], "question string, n_chunks long, prompt string")
        got = answers.answer(prompts, self.backend)
        cites = answers.citations(got, ranked).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "start_line", "end_line", "relevance"))).alias("citations"))
        return got.join(cites, "question", "left").select("question", "answer", "uncertainty", "citations")
