"""Exact cosine search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.text import snippet


#: Most hits of one query; what is broadcast in joins with hits is bounded by it.
MOST_HITS = 10_000


def top_k(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(chunk_id, score) of the k ids of vectors (chunk_id, embedding) most similar to the one row (embedding) of query; ties by id.

    An id with several vectors counts with its best one.  Null ids and embeddings and
    embeddings of another length than the query's are left out, a zero vector scores 0.
    Every task keeps its k best ids, so that what is shuffled doesn't grow with the rows.
    """
    if not 0 <= k <= MOST_HITS:
        raise ValueError(f"k must be from 0 to {MOST_HITS}")
    one = query.select("embedding").limit(1).collect() if k else []  # one row
    if not one or one[0][0] is None:
        return vectors.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    q = np.asarray(one[0][0], dtype=np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, float] = {}
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1)
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64) if len(rows) else np.zeros((0, len(q)))
            norms = np.linalg.norm(x, axis=1)
            scores = x @ q / np.where(norms == 0, 1, norms)
            low = min(best.values(), default=-2.0) if len(best) >= k else -2.0
            for n in np.flatnonzero(scores >= low).tolist():
                best[ids[n]] = max(best.get(ids[n], -2.0), float(scores[n]))
            if len(best) > 2 * k:
                best = dict(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k])
        kept = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.string()), pa.array([s for _, s in kept], pa.float64())], ["chunk_id", "score"])

    usable = vectors.where(F.col("chunk_id").isNotNull() & (F.size("embedding") == len(q)) & F.forall("embedding", lambda x: x.isNotNull()))
    found = usable.select(F.col("chunk_id").cast("string").alias("chunk_id"), "embedding").mapInArrow(local, "chunk_id string, score double")
    return found.groupBy("chunk_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


def hit_rows(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (chunk_id, score) with their chunk's columns; hits without a chunk are dropped, of a repeated id the smallest row counts.

    Hits are at most MOST_HITS rows, so they are sent to the chunks and only hit rows are compared.
    """
    columns = [c for c in ("repo_id", "file_path", "start_line", "end_line", "content") if c in chunks.columns]
    found = F.broadcast(hits).join(chunks.select("chunk_id", *columns), "chunk_id")
    return found.groupBy("chunk_id", "score").agg(F.min(F.struct(*columns)).alias("c")).select("chunk_id", "score", *[f"c.{c}" for c in columns])


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits joined to their chunks, with a snippet."""
    return hit_rows(hits, chunks).select("chunk_id", "file_path", "start_line", "end_line", F.round("score", 6).alias("score"), snippet(F.col("content")).alias("snippet"))


def batch_top_k(base: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, score): the k most similar rows of base (id, embedding) for each of queries (query_id, embedding).

    Queries and base are split into blocks by hash; every pair of blocks is one task's
    matrix product with a local top k, and the local results are ranked once more.  Sizes
    are counted first, so tasks stay of one size however large either side is.
    """
    spark = base.sparkSession
    n_base, n_query = base.count(), queries.count()
    bs, qs = max(1, -(-n_base // block)), max(1, -(-n_query // block))
    b = base.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(bs)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(qs - 1))).alias("q"))
    q = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(bs - 1))).alias("b"))

    def local(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        x, y = (np.stack(d["embedding"]).astype(np.float64) for d in (left, right))
        x /= np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
        y /= np.where((n := np.linalg.norm(y, axis=1, keepdims=True)) == 0, 1, n)
        ids = left["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        s = np.round(y @ x[order].T, 9)
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(right["query_id"].to_numpy(), best.shape[1]), "id": ids[order][best].ravel(), "score": np.take_along_axis(s, best, axis=1).ravel()})

    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *base.schema)}
    found = b.groupBy("b", "q").cogroup(q.groupBy("b", "q")).applyInPandas(local, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def local_hash_batches(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zlib

        for pdf in batches:
            out = []
            for text in pdf["text"]:
                v = np.zeros(dim, dtype=np.float32)
                for w in re.findall(r"\w+", (text or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1.0 if h & 0x80000000 else -1.0
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "embedding": out})

    return run


class HashEmbedder:
    """The offline embedder: signed feature hashing of words.  dimension is the length of its vectors."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def __call__(self, texts: DataFrame) -> DataFrame:
        """(chunk_id, embedding) of texts (chunk_id, text); null and wordless texts have zero vectors."""
        return texts.mapInPandas(local_hash_batches(self.dimension), "chunk_id string, embedding array<float>")


class ModelEmbedder:
    """Embedder around a model: load() gives, once per worker process, a function from a list of texts to vectors.

    Texts go through it BATCH at a time; null texts as empty ones.
    """

    BATCH = 64
    _loaded: dict = {}

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int, name: str = "model"):
        self.load, self.dimension, self.name = load, dimension, name

    def __call__(self, texts: DataFrame) -> DataFrame:
        load, dimension, name, size = self.load, self.dimension, self.name, self.BATCH

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loaded = ModelEmbedder._loaded
            if name not in loaded:
                loaded[name] = load()
            for pdf in batches:
                given = [t or "" for t in pdf["text"]]
                rows = [np.asarray(loaded[name](given[i : i + size]), dtype=np.float32).reshape(-1, dimension) for i in range(0, len(given), size)]
                yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "embedding": [v.tolist() for part in rows for v in part]})

        return texts.mapInPandas(run, "chunk_id string, embedding array<float>")


def embed(texts: DataFrame, dim: int = 384) -> DataFrame:
    """(chunk_id, embedding) of texts (chunk_id, text) by the offline embedder."""
    return HashEmbedder(dim)(texts)
