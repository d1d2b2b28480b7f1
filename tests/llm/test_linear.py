"""Splitting and tokenizing take time in proportion to their text."""

import time

import pytest

from srcloom.llm import splitting, tokens


@pytest.mark.parametrize("text", ["\n" * 300_000, " " * 500_000, "a\r\n" * 60_000, ("x = 1\n" * 20 + "\n") * 2000, "(" * 100_000, "é. " * 50_000])
def test_splitting_is_linear(text):
    began = time.process_time()
    spans = splitting.split_text(text)
    assert time.process_time() - began < 10 and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= splitting.MAX_CHARS for a, b in spans) and len(spans) <= 1.4 * len(text) / (splitting.MAX_CHARS - splitting.OVERLAP) + 2


def test_pieces_are_balanced():
    spans = splitting.split_text("word " * 1000)
    sizes = [b - a for a, b in spans]
    assert len(spans) == 4 and max(sizes) - min(sizes) <= splitting.OVERLAP + 10


def test_leaves_of_many_texts_are_joined_apart(spark):
    path = tokens.tokenizer_path()
    texts = ["a b " * 2000, "", "x" * 5000, "def f(a):\n    return a  # é\n" * 300, None, "short"]
    rows = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "k int, text string")
    want = sorted((i % 2, tokens._ids(path, t or "")) for i, t in enumerate(texts))
    assert len(tokens.halves(texts[0], tokens.LEAF_CHARS)) > 1
    assert sorted((r.k, r.ids) for r in tokens.encode(rows, "k").collect()) == want
    assert sorted((r.k, r.ids) for r in tokens.encode(rows, "k", spread=1000).collect()) == want, "repeated keys keep their rows"
