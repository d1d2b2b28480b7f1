"""Text decoded with the wrong character encoding: found and restored.

An unknown swap of code pages is a substitution cipher: a unit of garbled text (one
character, or the two to four characters of one UTF-8 letter) stands for a letter.  Runs
of non-ASCII characters are counted per source with their neighbours, so that the work
after one pass over the texts depends on the distinct runs only.  Readings of a run have
two origins.  Where a source has characters of its own, it may be written in a cipher
throughout, and expectation-maximisation learns what letter each of its units stands for
from the bigrams of the other sources.  For runs in sources that are garbled here and
there code-page tables give the letters, each under a hypothesis (written as E, read as
D).  A second expectation-maximisation learns the prior of each hypothesis in each
source: the E step weighs a run as it stands against its readings, the M step counts the
weights and takes the garbled runs out of the n-gram counts, so that they do not bear
each other out.  Decisions are put into the texts with translation tables.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.runtime import cut, parallelism

#: Code pages a text is commonly misread as, and written in.
READ_AS = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman", "iso8859_2", "gbk", "shift_jis", "big5")
WRITTEN_IN = ("cp1252", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp866", "koi8_r", "mac_roman", "iso8859_2")
#: Runs of characters outside ASCII; those parted by a letter or two are one, as they bear each other out.
RUN = re.compile(r"[^\x00-\x7f]++(?:[A-Za-z]{1,2}[^\x00-\x7f]++)*+")
ROUNDS = 4
#: Log odds, prior included, from which a reading is taken.
MARGIN = 1.5
#: Bigram and trigram counts are hashed into two tables of this fixed size, so what is broadcast doesn't grow.
SLOTS = 1 << 21
#: Smoothing mass of a context, and what the form of UTF-8 in a run of single-byte characters is worth, in nats.
SMOOTH, UTF8_FORM = 3.0, 5.0
#: Share of runs taken for garbled before the first round, and the most a source can come to; readings worth less are hopeless.
FIRST_GUESS, MOST_PRIOR, WORTH = 0.02, 0.9, -12.0
#: Posterior from which a run is taken out of the counts.
SURE = 0.9
LEARNED = "learned>"


@lru_cache(maxsize=32)
def _page(name: str) -> dict[str, int]:
    """Character to byte of a single-byte page; bytes the page leaves open are C1 controls."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


def _to_bytes(text: str, page: str) -> bytes | None:
    if page in ("gbk", "shift_jis", "big5"):
        try:
            return text.encode(page)
        except UnicodeEncodeError:
            return None
    table = _page(page)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


@lru_cache(maxsize=200_000)
def _utf8_readings(run: str, depth: int = 4) -> tuple[tuple[str, str], ...]:
    """(hypothesis, text) of the run read as UTF-8 that was taken for another page, up to depth times."""
    out: dict[str, str] = {}
    for page in READ_AS:
        raw = _to_bytes(run, page)
        if raw is None:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if text != run and not any("\x80" <= c <= "\x9f" for c in text):
            out.setdefault(text, f"utf_8>{page}")
        if depth > 1 and any(c > "\x7f" for c in text):
            for deeper, inner in _utf8_readings(text, depth - 1):
                out.setdefault(inner, f"{deeper}>{page}")
    return tuple((h, t) for t, h in out.items())


@lru_cache(maxsize=200_000)
def _utf8_inside(run: str) -> tuple[tuple[str, str], ...]:
    """Readings of runs of which only stretches are UTF-8 read as a single-byte page."""
    out: dict[str, str] = {}
    for page in READ_AS:
        if page in ("gbk", "shift_jis", "big5"):
            continue
        table = _page(page)
        raw = bytes(table.get(c, 0) for c in run)
        text, i, hits = [], 0, 0
        while i < len(raw):
            width = 2 if 0xC2 <= raw[i] <= 0xDF else 3 if 0xE0 <= raw[i] <= 0xEF else 4 if 0xF0 <= raw[i] <= 0xF4 else 1
            try:
                if width == 1:
                    raise ValueError
                text.append(raw[i : i + width].decode("utf-8"))
                i, hits = i + width, hits + 1
            except ValueError:
                text.append(run[i])
                i += 1
        found = "".join(text)
        if hits and not any("\x80" <= c <= "\x9f" for c in found):
            out.setdefault(found, f"part utf_8>{page}")
    return tuple((h, t) for t, h in out.items())


@lru_cache(maxsize=200_000)
def _swap_readings(run: str) -> tuple[tuple[str, str], ...]:
    """Readings of the run under a swap of two single-byte pages."""
    out: dict[str, str] = {}
    for read in WRITTEN_IN:
        raw = _to_bytes(run, read)
        if raw is None:
            continue
        for written in WRITTEN_IN:
            if written == read:
                continue
            try:
                text = raw.decode(written)
            except UnicodeDecodeError:
                continue
            if text != run:
                out.setdefault(text, f"{written}>{read}")
        if len(raw) > 3:
            for written in ("euc_jp", "shift_jis", "gbk", "euc_kr", "big5"):
                try:
                    out.setdefault(raw.decode(written), f"{written}>{read}")
                except UnicodeDecodeError:
                    pass
    return tuple((h, t) for t, h in out.items())


def readings(run: str) -> list[tuple[str, str]]:
    """All (hypothesis, text) the run can stand for; the first hypothesis of a text counts."""
    out: dict[str, str] = {}
    whole = _utf8_readings(run)
    for h, t in (*whole, *(() if whole else _utf8_inside(run)), *_swap_readings(run)):
        out.setdefault(t, h)
    return [(h, t) for t, h in out.items()]


_UNIGRAMS = 0x110000


def _slots(salt: int, *codes: np.ndarray) -> np.ndarray:
    """Two places of each n-gram in the table; the lesser count is the one with less of others in it."""
    h = np.full(len(codes[0]), 0x9E3779B97F4A7C15 + salt, dtype=np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    low = (h % np.uint64(SLOTS)).astype(np.int64)
    high = ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(SLOTS)).astype(np.int64)
    return np.stack([_UNIGRAMS + low, _UNIGRAMS + SLOTS + high])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of characters, of bigrams, and of the trigrams that hold a character outside ASCII: no others are asked for."""
    total = np.zeros(_UNIGRAMS + 2 * SLOTS, dtype=np.int64)
    for batch in batches:
        text = "\n\n" + "\n\n".join(x for x in batch.column(0).to_pylist() if x)
        for low in range(0, len(text), 1 << 20):
            codes = _codes(text[max(0, low - 2) : low + (1 << 20)])
            if len(codes) > 2:
                wide = codes > 127
                three = np.flatnonzero(wide[:-2] | wide[1:-1] | wide[2:])
                pair, n = np.unique(codes[1:-1].astype(np.int64) << 21 | codes[2:], return_counts=True)
                two = _slots(2, pair >> 21, pair & 0x1FFFFF)
                total[: int(codes.max()) + 1] += np.bincount(codes[2:], minlength=int(codes.max()) + 1)
                for places in two:
                    np.add.at(total, places, n)
                at, n = np.unique(_slots(3, codes[three], codes[three + 1], codes[three + 2]).ravel(), return_counts=True)
                total[at] += n
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"], strict=True):
            padded = f"\n\n{text}\n\n"
            seen = Counter((padded[m.start() - 2 : m.start()], m.group(), padded[m.end() : m.end() + 2]) for m in RUN.finditer(padded))
            out += [(doc, source, *x, n) for x, n in seen.items()]
        yield pd.DataFrame(out, columns=["doc_id", "source", "before", "run", "after", "n"])


def _stretches(texts: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all texts, places from each text's start to its end, where each text's places begin)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = _codes("".join(texts)).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    wide = sizes - starts
    first = np.cumsum(wide) - wide
    return codes, np.arange(int(wide.sum())) + np.repeat(begin + starts - first, wide), first


def _log_p(table: np.ndarray, total: float, texts: list[str], starts: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Log probability of each text from its start (2 at least), by interpolated trigrams; less is taken off every count."""
    if not texts:
        return np.zeros(0)
    codes, at, first = _stretches(texts, starts)
    less = np.repeat(less, np.diff(np.r_[first, len(at)]))
    off = lambda c: np.maximum(c.astype(np.float64) - less, 0)
    c, b, a = codes[at], codes[at - 1], codes[at - 2]
    uni, prev = off(table[c]), off(table[b])
    bi, pair = off(table[_slots(2, b, c)].min(axis=0)), off(table[_slots(2, a, b)].min(axis=0))
    tri = off(table[_slots(3, a, b, c)].min(axis=0))
    p1 = (uni + 0.01) / total
    p2 = (bi + SMOOTH * p1) / (np.maximum(prev, bi) + SMOOTH)
    p3 = (tri + SMOOTH * p2) / (np.maximum(pair, tri) + SMOOTH)
    return np.add.reduceat(np.log(p3), first)


def _attested(table: np.ndarray, texts: list[str], n: np.ndarray) -> np.ndarray:
    """Whether most three-letter windows of each text occur in the corpus, at least as often as the run it is to replace."""
    if not texts:
        return np.zeros(0, dtype=bool)
    codes, at, first = _stretches(texts, np.full(len(texts), 2))
    ok = table[_slots(3, codes[at - 2], codes[at - 1], codes[at])].min(axis=0) >= np.repeat(n, np.diff(np.r_[first, len(at)]))
    return np.add.reduceat(ok.astype(np.float64), first) / np.diff(np.r_[first, len(at)]) >= 0.6


def _plausible(before: str, run: str, text: str, after: str) -> bool:
    """A swap gives letters or quotes and dashes for visible characters, no small letter among capitals and no letter for a sign by itself."""
    if run.isspace() or not all(c.isalpha() or c in "\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u00bf\u00a1\u00ab\u00bb\u3001\u3002\u30fc" or unicodedata.category(c)[0] in "MN" for c in text if c > "\x7f"):
        return False
    near = [c for c in before + after if c.isalpha()]
    if len(run) == 1 and not run.isalpha() and not (before[-1:].isalpha() or after[:1].isalpha()):
        return False  # a sign that stands by itself is a sign
    return not (near and all(c.isupper() for c in near) and run.isupper() and text.islower())


_CASES = "before string, run string, after string, n long, swap string, reading string, kind tinyint"
#: How a reading is judged: the form of UTF-8 speaks for it, but letters read as letters must be known text all the same;
#: one character of a double-byte page or a swap of single characters must be known text.  A cipher's letters occur in its
#: source alone and so bear out nothing but themselves: as it stands it counts for nothing, and its reading must be known text.
FORM, LETTERS, ONE, SWAP, PLAIN, CIPHER = range(6)


def _kind(swap: str, run: str, text: str) -> int:
    if "utf_8" not in swap or swap[:4] == "part":
        return SWAP
    if len(run) == 1:
        return ONE
    if any(p in swap for p in ("gbk", "big5", "jis")):
        return PLAIN
    return LETTERS if all(c.isalpha() or c in "\u2018\u2019\u201c\u201d" for c in run + text) else FORM


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The readings of every run that page tables allow."""
    for pdf in batches:
        out = []
        for before, run, after, n in zip(pdf["before"], pdf["run"], pdf["after"], pdf["n"], strict=True):
            for swap, text in readings(run):
                kind = _kind(swap, run, text)
                if text and (kind != SWAP or _plausible(before, run, text, after)):
                    out.append((before, run, after, n, swap, text, kind))
        yield pd.DataFrame(out, columns=["before", "run", "after", "n", "swap", "reading", "kind"])


def _score(shared):
    """Adds to every case what its reading is worth over the text as it stands, in nats; hopeless ones go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        total = float(table[:_UNIGRAMS].sum(dtype=np.float64)) + 1
        for pdf in batches:
            before, stands, after, reading = (pdf[c].tolist() for c in ("before", "run", "after", "reading"))
            n, kind = pdf["n"].to_numpy(np.float64), pdf["kind"].to_numpy()
            starts = np.fromiter(map(len, before), dtype=np.int64, count=len(before))
            cipher = kind == CIPHER
            gain = _log_p(table, total, [b + t + a for b, t, a in zip(before, reading, after, strict=True)], starts, np.where(cipher, 0, n))
            gain -= _log_p(table, total, [b + t + a for b, t, a in zip(before, stands, after, strict=True)], starts, np.where(cipher, 1e12, n))
            gain[(kind == FORM) | (kind == LETTERS)] += UTF8_FORM
            doubtful = np.flatnonzero((gain > WORTH) & ((kind == SWAP) | (kind == LETTERS) | cipher | (kind == ONE) & (gain < 12)))
            known = _attested(table, [(before[k][-1:] + reading[k] + after[k][:1]) for k in doubtful], np.where(cipher, 1, n)[doubtful])
            keep = gain > WORTH
            keep[doubtful[~known]] = False
            yield pdf[keep].assign(gain=gain[keep])[["before", "run", "after", "swap", "reading", "gain"]]

    return run


# Ciphers -------------------------------------------------------------------------------------

#: A character is a source's own if this share of its occurrences is there.  A source is a cipher if its own characters
#: are this share of all it has, and if it has so many units; rarer ones than LEAST_COUNT are none.
OWN_SHARE, CIPHER_SHARE, LEAST_COUNT, LEAST_UNITS, MOST_UNITS = 0.8, 0.5, 5, 8, 128
#: Letters a unit can stand for, rounds of the EM, and the share of a unit's mass from which its letter is taken.
MOST_LETTERS, CIPHER_ROUNDS, CLEAR = 160, 24, 0.6


def _alphabet(table: np.ndarray, own: set[str]) -> str:
    """The most frequent letters outside ASCII that no source has for itself."""
    counts = table[:0x3000].copy()
    counts[:128] = 0
    letters = [chr(c) for c in np.argsort(-counts, kind="stable")[: 2 * MOST_LETTERS] if counts[c] > 0]
    return "".join([c for c in letters if c.isalpha() and c not in own][:MOST_LETTERS])


def _transitions(table: np.ndarray, letters: str) -> np.ndarray:
    """P(b | a) for a, b among ASCII and the letters, by interpolated bigrams."""
    codes = np.r_[np.arange(128), np.frombuffer(letters.encode("utf-32-le"), dtype=np.uint32)].astype(np.int64)
    a, b = np.repeat(codes, len(codes)), np.tile(codes, len(codes))
    uni = (table[codes] + 0.01) / (table[codes].sum() + 1)
    bi = table[_slots(2, a, b)].min(axis=0).reshape(len(codes), -1).astype(np.float64)
    return (bi + SMOOTH * uni) / (np.maximum(table[codes][:, None], bi.sum(axis=1, keepdims=True)) + SMOOTH)


def _one_to_one(odds: np.ndarray, times: int = 5) -> np.ndarray:
    """Rows of odds as shares; no letter may be taken by more than one unit's worth of them, which keeps the EM from giving all to a few letters."""
    odds = odds / odds.sum(axis=1, keepdims=True)
    for _ in range(times):
        odds = odds / np.maximum(odds.sum(axis=0, keepdims=True), 1.0)
        odds = odds / odds.sum(axis=1, keepdims=True)
    return odds


def _expect(shared):
    """How often each unit of a source stands for each letter, by forward and backward sums over every run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, step, ciphers = shared.value
        place = {c: k for k, c in enumerate(letters)}
        spot = lambda c: ord(c) if c < "\x80" else 128 + place[c] if c in place else 32
        hidden = step[128:, 128:]
        for pdf in batches:
            mass: dict[tuple[str, str], np.ndarray] = {}
            for source, before, text, after, n in zip(pdf["source"], pdf["before"], pdf["run"], pdf["after"], pdf["n"], strict=True):
                units, odds = ciphers[source]
                emit = [odds[units[c]] if c in units else np.eye(1, len(letters), place[c])[0] if c in place else None for c in text]
                # ASCII between two stretches of a run parts it.
                at = 0
                while at < len(text):
                    if emit[at] is None:
                        at += 1
                        continue
                    end = at
                    while end < len(text) and emit[end] is not None:
                        end += 1
                    left, right = spot(text[at - 1] if at else before[-1]), spot(text[end] if end < len(text) else after[0])
                    forward, f = [], step[left, 128:] * emit[at]
                    for k in range(at, end):
                        f = f if k == at else (f @ hidden) * emit[k]
                        f = f / max(f.sum(), 1e-300)
                        forward.append(f)
                    back = step[128:, right]
                    for k in range(end - 1, at - 1, -1):
                        p = forward[k - at] * back
                        total = p.sum()
                        if total > 0 and text[k] in units:
                            key = (source, text[k])
                            mass[key] = mass.get(key, 0) + n * p / total
                        back = hidden @ (emit[k] * back)
                        back = back / max(back.sum(), 1e-300)
                    at = end
            rows = [(s, u, k, m[k]) for (s, u), m in mass.items() for k in np.flatnonzero(m > 1e-4).tolist()]
            yield pd.DataFrame(rows, columns=["source", "unit", "letter", "mass"])

    return run


def mappings(types: DataFrame, table: np.ndarray, rounds: int = CIPHER_ROUNDS) -> dict[str, dict[str, str]]:
    """Unit to letter for every source that is written in a cipher: a page, known or not, taken for another throughout.

    A cipher is a source most of whose characters hardly another source has.  Which letters
    its units stand for is learned by expectation-maximisation against the bigrams of the
    other sources, from a start by frequency.  A character is the own one of one source at
    most and a cipher has MOST_UNITS at most, so what is collected is bounded by the number
    of characters there are.
    """
    spark = types.sparkSession
    char = F.explode(F.split("run", "")).alias("unit")
    per = types.select("source", char, "n").where("unit > '\x7f'").groupBy("source", "unit").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("source")
    per = per.withColumn("own", F.col("n") >= OWN_SHARE * F.sum("n").over(Window.partitionBy("unit")))
    per = per.withColumn("cipher", F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).over(of) >= CIPHER_SHARE * F.sum("n").over(of))
    per = per.where(F.col("cipher") & (F.col("n") >= LEAST_COUNT)).withColumn("units", F.count(F.lit(1)).over(of))
    own: dict[str, dict[str, int]] = {}
    alone = set()
    for r in per.where(F.col("units").between(LEAST_UNITS, MOST_UNITS)).select("source", "unit", "n", "own").collect():  # bounded, see above
        own.setdefault(r.source, {})[r.unit] = r.n
        alone |= {r.unit} if r.own else set()
    letters = _alphabet(table, alone)
    if not own or not letters:
        return {}
    step = _transitions(table, letters)
    share = np.log(np.array([table[ord(c)] for c in letters]) / sum(table[ord(c)] for c in letters))
    ciphers = {}
    for source, units in own.items():
        of = np.log(np.array([units[u] for u in units]) / sum(units.values()))
        odds = np.exp(-np.abs(of[:, None] - share[None, :]))
        ciphers[source] = ({u: k for k, u in enumerate(units)}, odds / odds.sum(axis=1, keepdims=True))
    held = cut(types.where(F.col("source").isin(*ciphers)).repartition(parallelism(spark)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((letters, step, ciphers))  # a row of letters for every unit
        got = held.mapInPandas(_expect(shared), "source string, unit string, letter int, mass double").groupBy("source", "unit", "letter").agg(F.sum("mass").alias("mass")).collect()
        odds = {s: np.full((len(u), len(letters)), 1e-6) for s, (u, _) in ciphers.items()}
        for r in got:
            odds[r.source][ciphers[r.source][0][r.unit], r.letter] += r.mass
        ciphers = {s: (u, _one_to_one(odds[s])) for s, (u, _) in ciphers.items()}
        shared.unpersist()
    return {s: {u: letters[o[k].argmax()] for u, k in units.items() if o[k].max() >= CLEAR} for s, (units, o) in ciphers.items()}


def _by_mapping(types: DataFrame, learned: dict[str, dict[str, str]]) -> DataFrame:
    """The readings of a cipher's runs by its mapping; a run with a unit that has no clear letter has none."""
    held = types.where(F.col("source").isin(*learned))
    reading = unclear = None
    for source, m in learned.items():
        if m:
            mine = F.translate("run", "".join(m), "".join(m.values()))
            reading = F.when(F.col("source") == source, mine) if reading is None else reading.when(F.col("source") == source, mine)
    if reading is None:
        return types.limit(0).selectExpr("before", "run", "after", "n", "'' AS swap", "'' AS reading", f"cast({CIPHER} AS tinyint) AS kind")
    rows = held.select("before", "run", "after", "n", F.concat(F.lit(LEARNED), "source").alias("swap"), reading.alias("reading"), F.lit(CIPHER).cast("tinyint").alias("kind"))
    return rows.where(F.col("reading") != F.col("run"))


def _moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What weighted readings take off the gram counts and add to them."""
    for pdf in batches:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for column, sign in (("run", -1.0), ("reading", 1.0)):
            texts = [b + t + a for b, t, a in zip(pdf["before"], pdf[column], pdf["after"], strict=True)]
            if not texts:
                continue
            starts = np.fromiter(map(len, pdf["before"]), dtype=np.int64, count=len(texts))
            codes, at, first = _stretches(texts, starts)
            w = sign * np.repeat(pdf["weight"].to_numpy(np.float64), np.diff(np.r_[first, len(at)]))
            places = np.concatenate([codes[at], *_slots(2, codes[at - 1], codes[at]), *_slots(3, codes[at - 2], codes[at - 1], codes[at])])
            parts.append((places, np.tile(w, 5)))
        if parts:
            places, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            yield pd.DataFrame({"slot": places.astype(np.int32), "n": np.bincount(back, weights=np.concatenate([w for _, w in parts]))})


def learn(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(occurrences, decisions) for docs (doc_id, source, text).

    occurrences has each doc's distinct runs with two characters of context, decisions
    the reading of every run of a source that is taken for garbled.
    """
    spark = docs.sparkSession
    texts = docs.where("text IS NOT NULL AND text != ''").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    got = texts.select("text").mapInArrow(_count_grams, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most as many rows as the table has places
    table = np.zeros(_UNIGRAMS + 2 * SLOTS, dtype=np.float32)
    table[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    counted = table  # as the texts stand; every round takes the garbled runs it sees out of it

    key = ["before", "run", "after"]
    occurrences = cut(texts.where(F.col("text").rlike(r"[^\x00-\x7f]")).mapInPandas(_runs, "doc_id long, source string, before string, run string, after string, n long"))
    types = cut(occurrences.groupBy("source", *key).agg(F.sum("n").alias("n")))
    # Few rows with much work each: dealt out evenly, whatever their size in bytes.
    spread = types.groupBy(*key).agg(F.sum("n").alias("n")).repartition(parallelism(spark))
    cases = spread.mapInPandas(_read, _CASES)
    if learned := mappings(types, table):
        cases = cases.unionByName(_by_mapping(types, learned))
    cases = cut(cases.repartition(parallelism(spark)))
    prior = None
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(table)
        scored = cases.mapInPandas(_score(shared), "before string, run string, after string, swap string, reading string, gain double")
        odds = types.join(scored, key)
        # A learned mapping holds for its own source.
        odds = odds.where(~F.startswith("swap", F.lit(LEARNED)) | (F.substring("swap", len(LEARNED) + 1, 1 << 20) == F.col("source")))
        first = F.lit(FIRST_GUESS / 20)
        odds = odds.withColumn("prior", first) if prior is None else odds.join(prior, ["source", "swap"], "left").withColumn("prior", F.coalesce("prior", first))
        odds = odds.withColumn("odds", F.exp(F.least(F.col("gain") + F.log(F.col("prior") / (1 - F.col("prior"))), F.lit(300.0))))
        post = cut(odds.withColumn("post", F.col("odds") / (1 + F.sum("odds").over(Window.partitionBy("source", *key)))))
        shared.unpersist()
        if k + 1 < rounds:
            # Of the runs a swap could have made, those it is taken to have made.
            mass = post.groupBy("source", "swap").agg(F.sum(F.col("post") * F.col("n")).alias("mass"), F.sum("n").alias("could"))
            prior = cut(mass.select("source", "swap", F.least(F.lit(MOST_PRIOR), (F.col("mass") + first) / (F.col("could") + 1)).alias("prior")))
            sure = post.where(F.col("post") > SURE).select(*key, "reading", (F.col("post") * F.col("n")).alias("weight"))
            moved = sure.mapInPandas(_moved, "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # bounded by the table
            table = counted.copy()
            np.add.at(table, moved.column("slot").to_numpy(), moved.column("n").to_numpy().astype(np.float32))
            np.maximum(table, 0, out=table)
    best = post.groupBy("source", *key).agg(F.max_by(F.struct("swap", "reading", "odds"), F.struct("odds", "reading")).alias("b"))
    decisions = best.where(F.log("b.odds") >= MARGIN).select("source", *key, "b.swap", "b.reading")
    return occurrences, cut(decisions)


def repair(docs: DataFrame) -> DataFrame:
    """Garbled documents: (doc_id, restored, fully, swaps) for docs (doc_id, source, text, ...).

    One row per document with at least one garbled stretch.  restored is its text with
    every stretch read back where that is possible; fully is false if it still holds
    U+FFFD, the mark of letters that were lost in decoding.  swaps lists the hypotheses.
    Null, empty and plain ASCII texts are never garbled.  A null source is a source of
    its own.  doc_id is taken to be unique.
    """
    docs = docs.select("doc_id", "source", "text")
    occurrences, decisions = learn(docs)
    key = ["source", "before", "run", "after"]
    fixes = occurrences.join(decisions, key).groupBy("doc_id").agg(F.collect_set(F.struct("before", "run", "after", "reading", "swap")).alias("fixes"))
    lost = F.col("text").contains("\ufffd")
    hit = docs.join(fixes, "doc_id", "left").where(F.col("fixes").isNotNull() | lost)
    return hit.select("doc_id", "text", "fixes").mapInPandas(_restore, "doc_id long, restored string, fully boolean, swaps array<string>")


def garbled_ids(docs: DataFrame) -> DataFrame:
    """Distinct doc_id of repair()'s rows, without the work of restoring."""
    docs = docs.select("doc_id", "source", "text")
    occurrences, decisions = learn(docs)
    found = occurrences.join(decisions, ["source", "before", "run", "after"], "left_semi").select("doc_id")
    return found.unionByName(docs.where(F.col("text").contains("\ufffd")).select("doc_id")).distinct()


def _restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, text, fixes in zip(pdf["doc_id"], pdf["text"], pdf["fixes"], strict=True):
            fixes = [] if fixes is None else list(fixes)
            known = {(f["before"], f["run"], f["after"]): f["reading"] for f in fixes}
            padded = f"\n\n{text}\n\n"
            # Single characters go through a translation table of their context, longer units are replaced whole.
            def read(m: re.Match, padded: str = padded, known: dict = known) -> str:
                run = m.group()
                reading = known.get((padded[m.start() - 2 : m.start()], run, padded[m.end() : m.end() + 2]), run)
                return run.translate(dict(zip(map(ord, run), reading, strict=True))) if len(run) == len(reading) == len(set(run)) else reading

            restored = RUN.sub(read, padded)[2:-2]
            out.append((doc, restored, "\ufffd" not in restored, sorted({f["swap"] for f in fixes})))
        yield pd.DataFrame(out, columns=["doc_id", "restored", "fully", "swaps"])
