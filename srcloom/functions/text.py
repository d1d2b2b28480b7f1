"""Text expressions: validity, lines, snippets, prompts, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that mark an answer as uncertain.
UNCERTAIN = ("insufficient", "unclear", "cannot determine", "not enough", "don't have enough", "no evidence", "not shown", "not present")
UNCERTAIN_NOTE = "The answer may be incomplete — the relevant code may not have been retrieved."
SNIPPET_CHARS, CLI_SNIPPET_CHARS, PROMPT_CHARS = 300, 200, 800


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def load_text(content: Column) -> Column:
    """Text of binary content: strict UTF-8 without NUL, with universal newlines; else null."""
    valid = F.is_valid_utf8(content.cast("string"))
    text = F.when(valid, content.cast("string"))
    return F.when(F.instr(text, "\x00") == 0, universal_newlines(text))


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based code point offset."""
    head = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def snippet(content: Column) -> Column:
    return F.substring(content, 1, SNIPPET_CHARS)


def cli_snippet(content: Column) -> Column:
    """Snippet of a result list: the first characters, white space stripped at both ends."""
    return F.regexp_replace(F.substring(snippet(content), 1, CLI_SNIPPET_CHARS), r"^[\s\x1c-\x1f\u0085\p{Z}]+|[\s\x1c-\x1f\u0085\p{Z}]+$", "")


def score_text(score: Column, digits: int = 3) -> Column:
    """A score with a fixed number of decimals: three of similarities, two of confidences."""
    return F.format_string(f"%.{digits}f", score)


# The formats of prompts and their blocks.


def prompt_block(rank: Column, path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.format_string("[%d] File: %s (lines %d–%d)\n```\n%s\n```", rank, path, start, end, F.substring(content, 1, PROMPT_CHARS))


def prompt(question: Column, blocks: Column) -> Column:
    return F.concat(
        F.lit("Code excerpts from the repository:\n"), F.array_join(blocks, "\n\n"), F.lit("\n\nQuestion: "), question,
        F.lit("\n\nAnswer based strictly on the excerpts above. Cite by [N] number."),
    )


def cited(answer: Column, n: Column) -> Column:
    """Sorted distinct 1-based numbers cited as [k] with 1 <= k <= n."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda s: F.try_to_number(F.substring(s, -18, 18), F.lit("9" * 18)).cast("long"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda k: (k >= 1) & (k <= n))))


def uncertainty(answer: Column) -> Column:
    low = F.lower(answer)
    hit = F.lit(False)
    for p in UNCERTAIN:
        hit = hit | low.contains(p)
    return F.when(hit, F.lit(UNCERTAIN_NOTE))
