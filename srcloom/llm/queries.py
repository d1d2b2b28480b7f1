"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.llm import docpairs, encoding, mixing, neighbours, provenance, secrets, splitting, syntax, tokens
from srcloom.runtime import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "chunks"))
    return pieces.groupBy("chunk_id").agg(F.max("piece_no").alias("last")).where("last > 0").select("chunk_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = docpairs.doc_pairs(table(spark, d, "chunks"), with_code=False)
    return pairs.where("doc_from = 'own'").select("repo_id", "file_path", "symbol_name", "start_line").distinct()


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.doc_pairs(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(table(spark, d, "chunks")).where("verdict != 'hand'").select("repo_id", "file_path")


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vectors"), table(spark, d, "chunks"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = neighbours.neighbours(table(spark, d, "vectors"), table(spark, d, "chunks"))
    return n.select("chunk_id", F.transform("neighbours", lambda e: e["chunk_id"]).alias("near_ids"), F.transform("neighbours", lambda e: e["similarity"]).alias("similarities"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_files(table(spark, d, "chunks")).select("repo_id", "file_path")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    s = secrets.secrets(table(spark, d, "chunks"))
    return s.select("repo_id", "file_path", F.explode("lines").alias("line_no")).distinct()


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secrets(table(spark, d, "chunks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    counts = cut(tokens.encode(docs.select(F.struct("doc_id", "source").alias("k"), "text"), "k", counts_only=True).select("k.doc_id", "k.source", "n_tokens"))
    return mixing.mix(counts, table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_ids(table(spark, d, "documents"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    fs = [p1_found, p1_pieces, p2_found, p2_pairs, p3_found, p3_files, p4_found, p4_neighbours, p5_found, p5_rates, p7_found, p7_redacted, p8_ids, p9_mixture, p9_report, p10_found, p10_restored]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    unit = """u AS (SELECT chunk_id, max(embedding)::DOUBLE[] AS e FROM vectors
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x != 0)) > 0
          AND chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY chunk_id)"""
    return {
        "p1_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(content) > 1600",
        "p4_found": f"""WITH {unit} SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM u a JOIN u b ON a.chunk_id < b.chunk_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
    }
