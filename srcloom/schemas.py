"""Schemas of the stored tables."""

from __future__ import annotations

FILES = "repo_id string, file_path string, language string, text string"
CHUNKS = "chunk_id string, repo_id string, file_path string, language string, start_line int, end_line int, symbols array<string>, imports array<string>, content string"
SYMBOLS = "symbol_name string, repo_id string, file_path string, start_line int, kind string"
EDGES = "repo_id string, source_file string, target_file string, edge_type string"
VECTORS = "chunk_id string, repo_id string, embedding array<float>"
TABLES = {"files": FILES, "chunks": CHUNKS, "symbols": SYMBOLS, "edges": EDGES, "vectors": VECTORS}
