"""Source files nobody wrote by hand: generated, minified, vendored and data files.

Every file is tokenised once.  Its tokens with identifiers, numbers and strings masked
give shingles of five; one-permutation MinHash sketches of them are banded, all files of
a band bucket are compared by the parities of their shingles, those that may be alike are
linked where their hashed shingle sets have a Jaccard similarity of at least 0.8, and
links are closed to families.  A family within one repository is the work of a generator if its members
carry its marks, a family across repositories a vendored copy if they carry a third
party's, and a family of files that are all but literals is data.  Marks are the
evidence a family is judged by; that two repositories hold nearly the same file is none.
Most flagged files have no near copy, and there the file's own marks decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm.files import assemble
from srcloom.runtime import cut

SUFFIXES = ("py", "ts", "tsx", "js", "jsx")
SHINGLE, SLOTS, ROWS = 5, 64, 4
SIMILAR = 0.8
#: Share of the shingles of two sets, counted in each, in which sets that are SIMILAR differ at most.
DIFFER = (1 - SIMILAR) / (1 + SIMILAR)
#: Parts of the shingles' values, a bit each.
PARITIES = 512
#: Members of a band bucket that one task compares with as many others; rows of one matrix product; members of a group that is compared without one.
BLOCK, TILE, SMALL = 1 << 16, 1024, 48
#: Others that a file's shingles are compared with in the first round, if there are more pairs than files.
FEW = 2
#: Share of a family's members with a mark from which it passes to the others.
FAMILY_SHARE = 0.5

_COMMENT = r"#(?!\w+\s*[(=])[^\n]*+|//[^\n]*+|/\*[\s\S]*?\*/"
#: A comment that begins a line comes with the line's end before it.
_TOKEN = re.compile(
    rf"\n[ \t]*+(?:{_COMMENT})|{_COMMENT}"
    r"|[rbufRBUF]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)"
    r"|\d[\w.]*+|[^\W\d][\w$]*+|[^\s\w]"
)

#: Words that stay in masked shingles.
_KEYWORDS = frozenset("and as async await break case catch class const continue def default del do elif else except export extends finally for from function if import in interface is let new not null None or pass raise return self static switch this throw True False true false try typeof undefined var void while with yield module exports enum type public private readonly lambda".split())
_CODE_WORDS = frozenset("def class function return if for while switch try import raise throw lambda interface with yield await async".split())

#: What generators, packers and third parties write into comments of their files.
_GENERATOR = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated\b|\bcode generated\b|\bgenerated (?:by|from|with|on|at)\s+\S|--\s*generated\b|\b(?:is|was|been) (?:automatically )?(?:generated|produced|compiled|emitted) (?:by|from)\b"
    r"|\bautomatically (?:generated|produced|created)\b|\bdo not (?:edit|modify|change)\b|\bmachine[- ](?:made|generated|written)\b|\bproduced (?:from|by) \S+\.\w+|\bcompiled from \S|\boutput of \S*(?:gen|compiler|forge|c)\b|\b(?:tool|generator|compiler)=\S+.*\b(?:input|source|template|schema)=\S"
    r"|\bedit the (?:template|source|schema|generator|input)\b|\b(?:manual|hand)[- ]?(?:made )?(?:changes?|edits?)\b.*\b(?:lost|overwritten|discarded)|\bchanges\b.*\b(?:lost|overwritten|not survive|discarded)"
    r"|\b(?:produit|généré|générée?s?) (?:automatiquement |par )|\bmodifications?\b.*\bperdues?\b|\bne pas (?:modifier|éditer)\b|\b(?:automatisch )?(?:generiert|erzeugt) (?:von|aus|mit|durch)\b|\bnicht (?:bearbeiten|ändern|editieren)\b|änderungen\b.*\bverloren"
    r"|\bgenerad[oa] (?:por|automáticamente|con|a partir)|\bno (?:editar|modificar)\b|\bcambios\b.*\bperder|\bgerad[oa] (?:por|automaticamente)|\bnão (?:edite|editar|modifique)|сгенерирован|не (?:редактир|изменя)|автоматически создан|自動生成|自动生成|編集しない|请勿(?:编辑|修改)|wygenerowan|nie edytowa|vygenerov|neupravuj|genererad (?:av|från)|redigera inte|tarafından (?:üretil|oluşturul)|düzenlemeyin"
)
#: A text without any of these stems has no generator's or third party's mark; they only save time.
_STEMS = ("tool=", "compiler=", "generat", "machine", "do not", "edit the", "manual", "hand", "changes", "output of", "produced", "emitted", "compiled", "created", "produit", "généré", "modif", "generier", "erzeugt", "nicht ", "änderungen", "generad", "editar", "cambios", "gerad", "não ", "сгенер", "не редакт", "не измен", "автоматич", "自動生成", "自动生成", "編集しない", "请勿", "wygener", "nie edyt", "vygener", "neuprav", "genererad", "redigera", "tarafından", "düzenle")
_THIRD_STEMS = ("vendor", "upstream", "licen", "cop", "preserve", "bundled", "third", "taken", "imported", "adapted", "fork", "mirror")
_DENIED = re.compile(r"(?i)\b(?:not|never|isn't|no longer|un|hand)[- ]?(?:auto-?)?(?:generated|compiled)|\bby hand\b|generated by hand")
_THIRD = re.compile(
    r"(?i)\bvendored (?:from|copy)|\bcopied (?:verbatim )?from \S+ v?\d|\bkeep in sync with upstream\b|\bsee upstream licen[sc]e\b|^\s*/\*!.*\bv?\d+\.\d+.*licen[sc]e|\b(?:local|unmodified|verbatim|vendored) copy of\b|\b(?:taken|imported|copied|adapted) (?:verbatim |unchanged |unmodified )?from \S+.*\b(?:release|version|v\d)|\bfork of \S+ v?\d|\bmirror of \S+ v?\d|@license\b|@preserve\b|\bbundled (?:copy )?(?:from|of) \S+ v?\d|\bthird[- ]party (?:code|copy|source)\b"
)
_VENDOR_DIR = re.compile(r"(?i)(?:^|/)(?:_?vendor(?:ed)?|third[_-]?party|node_modules|bower_components|bundled|externals?|extern|deps/upstream|upstream|site-packages)/")
_GENERATED_NAME = re.compile(r"(?i)(?:_pb2(?:_grpc)?\.py|\.(?:g|gen|generated|pb|designer)\.[jt]sx?|\.generated\.\w+|_pb\.[jt]s)$")
_MINIFIED_NAME = re.compile(r"(?i)[.-]min\.jsx?$")
_MACHINE = ("_serialized_start", "_serialized_end", "descriptor_runtime", "__descriptor_", "sourceMappingURL=")


#: Whether Spark removes the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _cut(df: DataFrame) -> DataFrame:
    """cut(), whose shuffle files go when the table is written; nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        return cut(df)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)


def _stable(token: str) -> int:
    h = 1469598103934665603
    for b in token.encode():
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


_NAME, _STRING, _NUMBER, _REMARK = _stable("name"), _stable("\""), _stable("0"), 0
_WORD_CODES = {w: _stable(w) for w in (*_KEYWORDS, *(chr(c) for c in range(33, 127) if not chr(c).isalnum()))}
_CODE_NUMBERS = np.array([_stable(w) for w in _CODE_WORDS], dtype=np.uint64)


class _Codes(dict):
    """Number of a token; all names, all strings and all numbers have one each, comments 0."""

    def __missing__(self, s: str) -> int:
        if len(self) > 300_000:
            self.clear()
            self.update(_WORD_CODES)
        # Marks outside ASCII have no code of their own and count as names, which only blurs shingles.
        c = s[0]
        got = self[s] = _NUMBER if c.isdigit() else _REMARK if len(s) > 1 and (c in "\n#" or s[:2] in ("//", "/*")) else _STRING if len(s) > 1 and s[-1] in "\"'`" else _NAME
        return got


_CODES = _Codes(_WORD_CODES)


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n codes."""
    h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def describe(path: str, text: str) -> tuple[str | None, bytes | None, bool, bytes | None]:
    """(mark, sketch, literal only, sorted 32-bit hashes of the shingles) of a file; mark is generated, minified, vendored, data or None."""
    found = _TOKEN.findall("\n" + text)
    codes = np.fromiter(map(_CODES.__getitem__, found), dtype=np.uint64, count=len(found))
    remarks = [found[k].lstrip() for k in np.flatnonzero(codes == _REMARK) if found[k][0] == "\n"]
    given = (codes == _STRING) | (codes == _NUMBER)
    literal = sum(len(found[k]) for k in np.flatnonzero(given))
    codes = codes[codes != _REMARK]
    count, shape, names = len(codes), int(given.sum()), int((codes == _NAME).sum())
    # Nearly every file has a word of code among its first tokens; the rest is read only if not.
    plain = not np.isin(codes[:128], _CODE_NUMBERS).any() and not np.isin(codes, _CODE_NUMBERS).any()
    size = len(text) - text.count(" ") - text.count("\n")
    only = count > 12 and plain and names <= 4 + shape // 20 and literal > 0.3 * size
    lines = text.count("\n") + 1
    joined = "\n".join(remarks)
    low, remark_lines = joined.lower(), joined.split("\n")
    mark = None
    if any(k in low for k in _STEMS) and any(_GENERATOR.search(x) and not _DENIED.search(x) for x in remark_lines):
        mark = "generated"
    elif _GENERATED_NAME.search(path) or any(k in text for k in _MACHINE) and int(np.isin(codes, _CODE_NUMBERS).sum()) <= 2 + lines // 50:
        mark = "generated"
    elif any(k in low for k in _THIRD_STEMS) and any(_THIRD.search(x) for x in remark_lines):
        mark = "vendored"
    elif _VENDOR_DIR.search(path):
        mark = "vendored"
    elif _MINIFIED_NAME.search(path) or (len(text) > 500 and len(text) / lines > 200 and text.count(" ") < 0.08 * len(text) and not only):
        mark = "minified"
    elif only and size > 300:
        mark = "data"
    elif plain and count > 60 and len(np.unique(_rolled(codes, 8))) < 0.12 * count:
        mark = "generated"  # one statement over and over
    if count < SHINGLE:
        return mark, None, only, None
    h = np.unique(_rolled(codes, SHINGLE))
    slot, value = (h % np.uint64(SLOTS)).astype(np.int64), (h >> np.uint64(8)) & np.uint64(0xFFFFFFFF)
    high = (h >> np.uint64(32)).astype(np.uint32)  # sorted, as h is
    sketch = np.full(SLOTS, 0xFFFFFFFF, dtype=np.uint64)
    np.minimum.at(sketch, slot, value)
    empty = sketch == 0xFFFFFFFF
    if empty.all():
        return mark, None, only, None
    if empty.any():  # an empty slot borrows from the next filled one
        filled = np.flatnonzero(~empty)
        take = filled[np.searchsorted(filled, np.flatnonzero(empty)) % len(filled)]
        sketch[empty] = (sketch[take] * np.uint64(0x85EBCA6B) + np.flatnonzero(empty).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return mark, sketch.astype(np.uint32).tobytes(), only, high[np.append(True, high[1:] != high[:-1])].tobytes()


def _describe_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for repo, path, text in zip(pdf["repo_id"], pdf["file_path"], pdf["text"], strict=True):
            mark, sketch, only, shingles = describe(path, text)
            bands = [] if sketch is None else [int.from_bytes(sketch[i : i + 4 * ROWS][:8], "little", signed=True) ^ int.from_bytes(sketch[i + 8 : i + 16], "little", signed=True) * 31 % (1 << 62) ^ (i << 52) for i in range(0, 4 * SLOTS, 4 * ROWS)]
            # Of the sketch only the bands and whether it equals another are asked for.
            out.append((repo, path, mark, only, sketch and blake2b(sketch, digest_size=16).digest(), shingles, [(b + (1 << 63)) % (1 << 64) - (1 << 63) for b in bands]))
        yield pd.DataFrame(out, columns=["repo_id", "file_path", "mark", "literal_only", "sketch", "shingles", "bands"])


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, odd, bands): the number of shingles, and of each of PARITIES parts of their values whether it holds an odd number."""
    for whole in batches:
        for batch in (whole.slice(k, 2048) for k in range(0, len(whole), 2048)):
            shingles = batch.column("shingles").to_pylist()
            n = np.array([len(x) // 4 for x in shingles], dtype=np.int64)
            place = np.repeat(np.arange(len(n)), n) * PARITIES + np.frombuffer(b"".join(shingles), dtype=np.uint32) % PARITIES
            odd = np.packbits(np.bincount(place, minlength=len(n) * PARITIES).reshape(-1, PARITIES) & 1 == 1, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int32)), pa.array([x.tobytes() for x in odd], pa.binary()), batch.column("bands")], ["id", "n", "odd", "bands"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (id, lead) of a group's members whose shingle sets can be SIMILAR; rows come sorted by band, part and n.

    Parts with an odd number in one of two sets only are at most as many as the shingles
    in which the sets differ, so no pair that is SIMILAR is left out.
    """
    rest = None
    for batch in batches:
        odd = np.frombuffer(b"".join(batch.column("odd").to_pylist()), dtype=np.uint8).reshape(-1, PARITIES // 8)
        now = [batch.column(k).to_numpy() for k in ("band", "part", "side", "id", "n")] + [odd]
        if rest and len(now[0]) and (rest[0][0][0], rest[0][1][0]) == (now[0][-1], now[1][-1]):
            rest.append(now)  # one group fills the batch and goes on
            continue
        now = [np.concatenate(x) for x in zip(*rest, now, strict=True)] if rest else now
        if not len(now[0]):
            continue
        last = int(np.flatnonzero(np.append(True, (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])))[-1])
        rest = [[x[last:] for x in now]]
        yield from _of_groups(*(x[:last] for x in now))
    if rest:
        yield from _of_groups(*(np.concatenate(x) for x in zip(*rest, strict=True)))


def _of_groups(band: np.ndarray, part: np.ndarray, side: np.ndarray, ids: np.ndarray, n: np.ndarray, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of whole groups."""
    if not len(band):
        return
    start = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (part[1:] != part[:-1])))
    size = np.diff(np.append(start, len(band)))
    small = np.repeat((size <= SMALL) & (side[start] == 2), size)
    # Small groups go together: every row with the row that stands d further on.
    words, end, row = odd.view(np.uint64), np.repeat(start + size, size), np.flatnonzero(small)
    for d in range(1, SMALL):
        row = row[row + d < end[row]]
        if not len(row):
            break
        for at in np.array_split(row, len(row) // 100_000 + 1):
            other = at + d
            near = n[at] >= SIMILAR * n[other] - 0.005
            at, other = at[near], other[near]
            differ = np.bitwise_count(words[at] ^ words[other]).sum(axis=1, dtype=np.int32)
            near = differ <= DIFFER * (n[at] + n[other]) + 0.005
            yield _pairs(ids[at[near]], ids[other[near]])
    for k in np.flatnonzero((size > SMALL) | (side[start] != 2)):
        group = slice(start[k], start[k] + size[k])
        own, of = side[group] != 1, (ids[group], n[group], odd[group])
        if side[start[k]] == 2:
            yield from _of_block(*of, *of, True)
        elif not own.all():
            yield from _of_block(*(x[own] for x in of), *(x[~own] for x in of), False)


def _of_block(ids: np.ndarray, n: np.ndarray, odd: np.ndarray, ids2: np.ndarray, n2: np.ndarray, odd2: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
    """The pairs between two lists sorted by n; a list and itself gives each pair once.

    Of signs -1 and 1 the product is PARITIES less twice the parts that differ; two more columns add the bound
    (never more than what lets all pairs through, so that float32 holds it).
    """
    for i in range(0, len(n), TILE):
        a = np.ones((len(n[i : i + TILE]), PARITIES + 2), dtype=np.float32)
        a[:, :PARITIES] = np.unpackbits(odd[i : i + TILE], axis=1) * np.float32(2) - 1
        a[:, PARITIES] = np.minimum(2 * DIFFER * n[i : i + TILE], 2 * PARITIES)
        low = i if same else int(np.searchsorted(n2, SIMILAR * n[i] - 0.005))
        high = int(np.searchsorted(n2, n[i : i + TILE][-1] / SIMILAR + 0.005, "right"))
        for j in range(low, high, TILE):
            m = min(high, j + TILE) - j
            b = np.ones((m, PARITIES + 2), dtype=np.float32)
            b[:, :PARITIES] = np.unpackbits(odd2[j : j + m], axis=1) * np.float32(2) - 1
            b[:, PARITIES + 1] = np.minimum(2 * DIFFER * n2[j : j + m], 2 * PARITIES)
            x, y = np.divmod(np.flatnonzero((a @ b.T).ravel() >= PARITIES - 0.01), m)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            near = np.minimum(n[x + i], n2[y + j]) >= SIMILAR * np.maximum(n[x + i], n2[y + j]) - 0.005
            yield _pairs(ids[x[near] + i], ids2[y[near] + j])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["id", "lead"])


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        n, both = (len(x) + len(y)) // 4, np.concatenate([np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        out.append(common / (n - common))
    return pd.Series(out, dtype="float64")


def _candidates(reps: DataFrame) -> DataFrame:
    """Distinct pairs (id, lead) of reps (id, n, odd, bands) that share a bucket and may be SIMILAR.

    All members of a bucket are compared.  A bucket of more than BLOCK members is cut into
    blocks, and every two of them are compared in a group of their own.
    """
    banded = reps.select("id", "n", "odd", F.explode(F.array_distinct("bands")).alias("band"))
    # At most 16 / BLOCK of the number of files.
    large = reps.select(F.explode(F.array_distinct("bands")).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    member = banded.join(F.broadcast(large), "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    member = member.select("band", "id", "n", "odd", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    part = F.shiftleft(F.least("own", "other").cast("long"), 32) + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = member.select("band", part.alias("part"), side.alias("side"), "id", "n", "odd")
    return rows.repartition("band", "part").sortWithinPartitions("band", "part", "n").mapInArrow(_alike, "id long, lead long").distinct()


def _closed(edges: DataFrame) -> DataFrame:
    """(id, family): the smallest id that edges (id, lead) lead to, for every id with one."""
    both = _cut(edges.unionByName(edges.select(F.col("lead").alias("id"), F.col("id").alias("lead"))))
    label = _cut(both.groupBy("id").agg(F.min("lead").alias("family")).select("id", F.least("id", "family").alias("family")))
    while True:
        near = both.join(label.toDF("lead", "f"), "lead").groupBy("id").agg(F.min("f").alias("f"))
        moved = label.join(near, "id").select("id", F.least("family", "f").alias("next"), "family")
        # Pointer jumping: a label's own label is at least as small.
        jump = moved.select(F.col("id").alias("next"), F.col("next").alias("far"))
        new = _cut(moved.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("family"), F.col("family").alias("old")))
        label = new.select("id", "family")
        if new.where("family != old").isEmpty():
            return label


def _linked(pairs: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """(id, family): pairs (id, lead) whose sets (id, shingles) are SIMILAR, closed over links.

    Sets are put beside `most` pairs at a time.  Where there are more, every file is first
    compared with a few others, and a pair of which both are in one family by then needs no
    comparison any more; all others get one.
    """
    edges, few, n = None, FEW, pairs.count()
    while True:
        last = n <= most
        if not last:
            pairs = _cut(pairs.withColumn("nth", F.row_number().over(Window.partitionBy("lead").orderBy("id"))))
        now = pairs if last else pairs.where(F.col("nth") <= few)
        slices = 1 if last else -(-now.count() // most)
        for k in range(slices):
            part = now.where(F.pmod(F.xxhash64("id", "lead"), F.lit(slices)) == k) if slices > 1 else now
            beside = part.select("id", "lead").join(sets, "id").join(sets.toDF("lead", "lead_shingles"), "lead")
            found = _cut(beside.where(F.pandas_udf(_jaccard, "double")("shingles", "lead_shingles") >= SIMILAR).select("id", "lead"))
            edges = edges.unionByName(found) if edges else found
        label = _closed(edges)
        if last:
            return label
        of = lambda k: label.select(F.col("id").alias(k), F.col("family").alias(f"{k}_family"))  # noqa: B023, E731
        left = pairs.where(F.col("nth") > few).join(of("id"), "id", "left").join(of("lead"), "lead", "left")
        pairs = _cut(left.where("id_family IS NULL OR lead_family IS NULL OR id_family != lead_family").select("id", "lead"))
        edges, few, n = label.where("id != family").toDF("id", "lead"), few * 4, pairs.count()
        if not n:
            return label


def families(files: DataFrame) -> DataFrame:
    """(id, family): files (id, sketch, shingles, bands) whose masked shingles agree, closed over links.

    Files of equal sketches count as one.  Of the others all that share a bucket are
    compared, first by the parities of their shingles, then by their shingle sets.  Closing
    takes the smallest id along links until nothing changes.
    """
    same = files.select("id", F.unhex(F.md5("sketch")).alias("sketch"))
    equal = _cut(same.join(same.groupBy("sketch").agg(F.min("id").alias("lead")), "sketch").select("id", "lead"))
    reps = files.select("id", "shingles", "bands").mapInArrow(_parities, "id long, n int, odd binary, bands array<long>")
    reps = _cut(reps.join(equal.where("id = lead").select("id"), "id", "left_semi"))
    label = _linked(_cut(_candidates(reps)), files.select("id", "shingles"), reps.count())
    return equal.join(label.toDF("lead", "family"), "lead", "left").select("id", F.coalesce("family", "lead").alias("family"))


def provenance(chunks: DataFrame) -> DataFrame:
    """(repo_id, file_path, verdict, decided_by, mark, family_size, family_repos) of every source file.

    verdict is generated, minified, vendored, data or hand.  It is the family's, where its
    members' marks agree by FAMILY_SHARE, and passes to members without a mark of their own
    if more than two files stand behind it; a file without a family is one of its own.
    decided_by is family (of two files or more), own (the mark of the file alone) or null.
    Null contents and paths are left out; repeated rows and second ingests give one row; a
    null repo_id is a repository of its own.
    """
    files = assemble(chunks, SUFFIXES).mapInPandas(_describe_all, "repo_id string, file_path string, mark string, literal_only boolean, sketch binary, shingles binary, bands array<long>")
    files = _cut(files.withColumn("id", F.monotonically_increasing_id()))
    fam = families(files.where("sketch IS NOT NULL").select("id", "sketch", "shingles", "bands"))
    rows = files.select("id", "repo_id", "file_path", "mark", "literal_only").join(fam, "id", "left").withColumn("family", F.coalesce("family", "id"))
    has = lambda *marks: F.avg(F.coalesce(F.col("mark").isin(*marks), F.lit(False)).cast("double"))
    about = rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("family_size"), F.countDistinct("repo_id").alias("family_repos"), has("generated").alias("generated"), has("minified").alias("minified"),
        has("vendored").alias("vendored"), has("data").alias("data"), F.avg(F.col("literal_only").cast("double")).alias("literal"),
    )
    most = F.greatest("generated", "minified", "vendored")
    of_family = (
        F.when((F.col("literal") >= FAMILY_SHARE) & (F.col("data") > 0), "data")
        .when(F.col("generated") + F.col("minified") + F.col("vendored") < FAMILY_SHARE, None)
        # Copies in several repositories come from a third party if any says so, copies within one from a tool.
        .when((F.col("family_repos") > 1) & (F.col("vendored") == most), "vendored")
        .when(F.col("minified") == most, "minified")
        .when(F.col("generated") > 0, "generated")
        .otherwise("vendored")
    )
    j = rows.join(about, "family").withColumn("of_family", F.when(F.col("family_size") > 1, of_family))
    passed = F.when((F.col("family_size") > 2) & ((F.col("of_family") != "data") | F.col("literal_only")), F.col("of_family"))
    verdict = F.coalesce("mark", passed)
    by = F.when(verdict.isNull(), None).when(F.col("of_family").isNotNull(), "family").otherwise("own")
    return j.select(
        "repo_id", "file_path", F.coalesce(verdict, F.lit("hand")).alias("verdict"), by.alias("decided_by"), "mark", F.col("family_size").cast("int").alias("family_size"), F.col("family_repos").cast("int").alias("family_repos")
    )
