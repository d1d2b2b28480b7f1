"""Token ids of whole texts by a public tokenizer, joined as a monoid.

A text is halved until its leaves are small; leaves are encoded on their own and
neighbours are joined by encoding a window around the seam again.  The window grows
on both sides until it ends where the tokenizer's own pre-splitting must end a
token whatever surrounds the place (see _FIXED): tokens outside the window then
cannot change, so the joined ids are those of the whole text.  Joining is
associative, so leaves of one text can be encoded in different tasks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.runtime import parallelism

#: Code points of a leaf, and of a text whose leaves are encoded in tasks of their own.
LEAF_CHARS, SPREAD_CHARS = 1 << 11, 1 << 18

#: No pre-split piece of the byte-level pattern spans these places: white space after
#: other text, a digit beside a letter, punctuation after a letter or digit.
_FIXED = re.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _ids(path: str, text: str) -> list[int]:
    return _tokenizer(path).encode(text, add_special_tokens=False).ids


class Encoded:
    """Monoid element: head + middle + tail of a text, parted at fixed places.

    The ids of the middle are final.  Head and tail hold no fixed place inside and wait
    for their neighbours; a text without any fixed place is all head and its middle is None.
    """

    __slots__ = ("head", "middle", "tail")

    def __init__(self, head: str, middle: list[int] | None, tail: str):
        self.head, self.middle, self.tail = head, middle, tail

    @staticmethod
    def parts(text: str) -> tuple[str, str | None, str]:
        """Head, middle and tail of a leaf as texts."""
        first = _FIXED.search(text)
        if not first:
            return text, None, ""
        a, width = first.start(), 256
        while True:  # the last fixed place, looked for from the end in growing windows
            low = max(a, len(text) - width)
            last = max((m.start() for m in _FIXED.finditer(text, low)), default=a if low == a else None)
            if last is not None:
                return text[:a], text[a:last], text[last:]
            width *= 4

    @classmethod
    def leaf(cls, path: str, text: str) -> Encoded:
        return cls.leaves(path, [text])[0]

    @classmethod
    def leaves(cls, path: str, texts: list[str]) -> list[Encoded]:
        """Elements of many leaves, their middles encoded in one call."""
        parts = [cls.parts(t) for t in texts]
        ids = [e.ids for e in _tokenizer(path).encode_batch([m or "" for _, m, _ in parts], add_special_tokens=False)]
        return [cls(h, None if m is None else i, t) for (h, m, t), i in zip(parts, ids, strict=True)]

    def join(self, path: str, right: Encoded) -> Encoded:
        """The window around the seam grows to the nearest fixed places; what lies outside is final."""
        if self.middle is not None and right.middle is not None:
            return Encoded(self.head, self.middle + _ids(path, self.tail + right.head) + right.middle, right.tail)
        near, behind = (self.head if self.middle is None else self.tail), right.head
        parted = any(m.start() == 1 for m in _FIXED.finditer(near[-1:] + behind[:1])) if near and behind else False
        if self.middle is None and right.middle is None:
            return Encoded(near, [], behind) if parted else Encoded(near + behind, None, "")
        if self.middle is None:
            return Encoded(near, _ids(path, behind) + right.middle, right.tail) if parted else Encoded(near + behind, right.middle, right.tail)
        return Encoded(self.head, self.middle + _ids(path, near), behind) if parted else Encoded(self.head, self.middle, near + behind)

    def ids(self, path: str) -> list[int]:
        return _ids(path, self.head) + (self.middle or []) + _ids(path, self.tail)


def halves(text: str, leaf: int) -> list[str]:
    """The text's leaves from left to right: it is halved until they are small."""
    out, todo = [], [text]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.append(part)
        else:
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return out


def encode_text(path: str, text: str, leaf: int = LEAF_CHARS) -> Encoded:
    """The text's element."""
    return fold(path, Encoded.leaves(path, halves(text, leaf)))


def fold(path: str, parts: list[Encoded]) -> Encoded:
    """Join neighbours pairwise up the tree."""
    while len(parts) > 1:
        parts = [parts[i].join(path, parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _list_array(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encode_rows(path: str, leaf: int, counts_only: bool):
    """Rows of texts: their leaves are encoded together and joined text by text; a text of one leaf needs no joining."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = _tokenizer(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                got = [e.ids for e in t.encode_batch([x if len(x) <= leaf else "" for x in texts], add_special_tokens=False)]
                large = [k for k, x in enumerate(texts) if len(x) > leaf]
                cuts = [halves(texts[k], leaf) for k in large]
                elements = iter(Encoded.leaves(path, [x for c in cuts for x in c]))
                for k, c in zip(large, cuts, strict=True):
                    got[k] = fold(path, [next(elements) for _ in c]).ids(path)
                value = pa.array([len(g) for g in got], pa.int64()) if counts_only else _list_array(got)
                yield pa.RecordBatch.from_arrays([part.column(0), value], ["row", "value"])

    return run


def _leaves(leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                texts = halves(batch.column(2)[k].as_py(), leaf)
                at = pa.array([k] * len(texts), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], ["row", "at", "no", "text"])

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = Encoded.leaves(path, batch.column(3).to_pylist())
            parts = [pa.array([e.head for e in done], pa.string()), pa.array([e.middle for e in done], pa.list_(pa.int32())), pa.array([e.tail for e in done], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *parts], ["row", "at", "no", "head", "middle", "tail"])

    return run


def encode(docs: DataFrame, key: str, text: str = "text", tokenizer: str | None = None, leaf: int = LEAF_CHARS, spread: int = SPREAD_CHARS, counts_only: bool = False) -> DataFrame:
    """(key, ids) of every row: the ids of its whole text, without special tokens.

    Null and empty texts have no ids ([]); blank texts have those of their blanks.
    Strings of special tokens in a text are ordinary text.  Repeated keys keep their rows.
    With counts_only the second column is n_tokens.  Other columns are dropped.
    """
    path = tokenizer or tokenizer_path()
    out = "n_tokens" if counts_only else "ids"
    kind = "long" if counts_only else "array<int>"
    rows = docs.select(F.col(key).alias("row"), F.col(text).alias("text"))
    key_type = rows.schema["row"].dataType.simpleString()
    long_text = F.coalesce(F.length("text") > spread, F.lit(False))
    small = rows.where(~long_text).mapInArrow(_encode_rows(path, leaf, counts_only), f"row {key_type}, value {kind}")

    def join_leaves(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        parts = [Encoded(h, m, t) for h, m, t in zip(table["head"].to_pylist(), table["middle"].to_pylist(), table["tail"].to_pylist(), strict=True)]
        ids = fold(path, parts).ids(path)
        value = pa.array([len(ids)], pa.int64()) if counts_only else pa.array([ids], pa.list_(pa.int32()))
        return pa.table([table["row"].slice(0, 1), value], names=["row", "value"])

    # The number of a long text is made once and goes with its leaves; nothing is joined by it afterwards.
    large = rows.where(long_text).select("row", F.monotonically_increasing_id().alias("at"), "text")
    leaves = large.mapInArrow(_leaves(leaf), f"row {key_type}, at long, no int, text string")
    encoded = leaves.repartition(parallelism(docs.sparkSession)).mapInArrow(_encode_leaves(path), f"row {key_type}, at long, no int, head string, middle array<int>, tail string")
    joined = encoded.groupBy("at").applyInArrow(join_leaves, f"row {key_type}, value {kind}")
    return small.unionByName(joined).toDF(key, out)
