"""Index a source tree, or ask the index: search, definition, impact, ask."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from srcloom.engine import Engine
from srcloom.functions.text import cli_snippet, score_text
from srcloom.runtime import local_session

#: References a definition lists.
SHOWN_REFERENCES = 10
_TITLES = {"high": "High confidence", "medium": "Medium confidence", "related": "Related"}


def show_search(engine: Engine, repo_id: str, query: str, top_k: int = 10) -> list[str]:
    hits = engine.search(query, repo_id, top_k).select("*", score_text(F.col("score")).alias("shown"), cli_snippet(F.col("snippet")).alias("line")).collect()  # at most top_k rows
    lines = [f"{len(hits)} results for: {query}"]
    for n, h in enumerate(hits, 1):
        lines += [f"{n}. {h.file_path} ({h.start_line}-{h.end_line}), {h.shown}", f"   {h.line}"]
    return lines


def show_definition(engine: Engine, repo_id: str, symbol: str) -> list[str]:
    listed = F.slice("references", 1, SHOWN_REFERENCES)
    d = engine.definition(symbol, repo_id).select("defining_file", "start_line", "kind", F.size("references").alias("n"), listed.alias("listed")).first()
    return [f"{symbol}: {d.kind or 'symbol'} in {d.defining_file}, line {d.start_line}", f"{d.n} files with it:" if d.n else "No references.", *(f"   {r}" for r in d.listed)]


def show_impact(engine: Engine, repo_id: str, target: str, depth: int = 3) -> list[str]:
    rows = engine.impact(target, repo_id, depth).select("bucket", "file_path", "reason", score_text(F.col("confidence"), 2).alias("shown"), "confidence", "depth")
    found: dict[str, list[str]] = {}
    for r in rows.orderBy(F.desc("confidence"), "depth", "file_path").toLocalIterator():
        found.setdefault(r.bucket, []).append(f"   {r.shown} {r.file_path}: {r.reason}")
    return [f"Impact of {target}", *(x for b, title in _TITLES.items() if b in found for x in (title, *found[b]))]


def show_ask(engine: Engine, repo_id: str, question: str, top_k: int = 8) -> list[str]:
    a = engine.ask(question, repo_id, top_k).first()
    cited = [f"   {c.file_path} ({c.start_line}-{c.end_line}): {c.relevance}" for c in a.citations or []]
    return [a.answer, *(["Cited:", *cited] if cited else []), *([f"Note: {a.uncertainty}"] if a.uncertainty else [])]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="srcloom", description=__doc__)
    p.add_argument("store", help="folder of the index")
    modes = p.add_subparsers(dest="mode", required=True)
    modes.add_parser("health")
    for mode, what in (("ingest", "folder"), ("search", "query"), ("definition", "symbol"), ("impact", "target"), ("ask", "question")):
        m = modes.add_parser(mode)
        m.add_argument("repo_id")
        m.add_argument("text", metavar=what)
        if mode in ("search", "ask"):
            m.add_argument("--top-k", type=int, default=10 if mode == "search" else 8)
        if mode == "impact":
            m.add_argument("--depth", type=int, default=3)
    return p


def run(engine: Engine, args: argparse.Namespace) -> list[str]:
    """The lines to print."""
    if args.mode == "health":
        return [f"{k}: {v}" for k, v in engine.health().items()]
    if args.mode == "ingest":
        return [f"{k}: {v}" for k, v in engine.ingest(args.text, args.repo_id).first().asDict().items()]
    if args.mode == "search":
        return show_search(engine, args.repo_id, args.text, args.top_k)
    if args.mode == "definition":
        return show_definition(engine, args.repo_id, args.text)
    if args.mode == "impact":
        return show_impact(engine, args.repo_id, args.text, args.depth)
    return show_ask(engine, args.repo_id, args.text, args.top_k)


def main(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    try:
        print("\n".join(run(Engine(local_session(), args.store), args)))
    except LookupError as e:
        print(f"not found: {e}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
