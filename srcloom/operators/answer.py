"""Cited answers over retrieved chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.functions import text as T

SYSTEM_PROMPT = "Answer questions about source code from the given excerpts alone. Cite the excerpts that support each statement and say so when they do not suffice."
NO_RESULTS = "The index holds nothing that bears on the question."


def extractive_answer(prompt: str) -> str:
    """Offline backend: names the first excerpt and its citation."""
    head = next((x for x in prompt.split("\n") if x.startswith("[1] File: ")), "")
    return f"The most relevant excerpt is {head[10:]} [1]." if head else "The excerpts are insufficient."


def build_prompts(ranked: DataFrame) -> DataFrame:
    """(question, n_chunks, prompt) of ranked (question, rank, file_path, start_line, end_line, content)."""
    block = T.prompt_block(F.col("rank"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content"))
    g = ranked.withColumn("block", block).groupBy("question").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("bs"))
    return g.select("question", "n_chunks", T.prompt(F.col("question"), F.transform("bs", lambda b: b["block"])).alias("prompt"))


#: Fixed value: what a citation says of itself.
RELEVANCE = "Cited as [%d] in the answer"


def citations(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per cited chunk: answers (question, answer, n_chunks) joined to ranked by the numbers cited."""
    hits = answers.select("question", F.explode(T.cited(F.col("answer"), F.col("n_chunks"))).alias("rank"))
    return hits.join(ranked, ["question", "rank"]).select("question", "rank", "file_path", "start_line", "end_line", F.format_string(RELEVANCE, "rank").alias("relevance"))


def answer(prompts: DataFrame, backend: Callable[[str], str] = extractive_answer) -> DataFrame:
    """(question, n_chunks, answer, uncertainty) by an injected backend; prompts without chunks don't reach it.

    A backend with an attribute takes_system is called with SYSTEM_PROMPT and the prompt.
    """
    call = (lambda p: backend(SYSTEM_PROMPT, p)) if getattr(backend, "takes_system", False) else backend

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"question": pdf["question"], "n_chunks": pdf["n_chunks"], "answer": [call(p) if n else NO_RESULTS for p, n in zip(pdf["prompt"], pdf["n_chunks"], strict=True)]})

    return prompts.mapInPandas(run, "question string, n_chunks long, answer string").withColumn("uncertainty", F.when(F.col("n_chunks") == 0, F.lit("No excerpts were retrieved.")).otherwise(T.uncertainty(F.col("answer"))))
