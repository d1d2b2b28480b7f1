"""Credentials in source files: found through a trigram index and redacted in place.

From every detection pattern the trigrams are derived that any match must contain, as
alternatives of sets.  One pass over the chunks builds the postings of those trigrams,
a bitmap per block of chunks; sets are intersected in the block, so only the names of
candidate files are shuffled, and patterns are verified on the files that hold a whole
set.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.files import assemble

_NAME = r"(?:pass|pwd|pw(?=[ =:\"'`0123456789])|kennwort|contrase|senha|haslo|heslo|parola|losenord|lykilord|sifre|secret|api[_-]?key|access[_-]?key|secret[_-]?key|signing[_-]?key|private[_-]?key|service[_-]?key|encryption[_-]?key|account[_-]?key|deploy[_-]?key|master[_-]?key|auth[_-]?key|token|credential)"
#: The detection patterns.  Named groups value and name say what is judged.
PATTERNS: dict[str, str] = {
    "provider_key": r"(?<![0-9A-Za-z_])(?P<value>(?:sk_live_|sk_test_|rk_live_)[0-9A-Za-z]{16,}|(?:ghp_|gho_|ghu_|ghs_|ghr_)[0-9A-Za-z]{30,}|github_pat_[0-9A-Za-z_]{30,}|glpat-[0-9A-Za-z_-]{18,}|xox[abeprs]-[0-9A-Za-z-]{18,}|(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|npm_[0-9A-Za-z]{36}|pypi-[0-9A-Za-z_-]{40,}|SG\.[\w-]{16,}\.[\w-]{16,})(?![0-9A-Za-z])",
    "web_token": r"(?<![\w.-])(?P<value>eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{16,})",
    "connection": r"(?i)(?:AccountKey|SharedAccessKey|Password|Pwd)=(?P<value>[^\s;'\"`<>{}$]{8,})",
    "url": r"(?i)\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@'\"`<>]*:(?P<value>[^\s@/'\"`<>]{3,})@[\w.\[-]",
    "basic": r"(?i)\bBasic\s+(?P<value>[A-Za-z0-9+/]{8,}={0,2})",
    "bearer": r"(?i)\bBearer\s+(?P<value>[0-9A-Za-z._~+/-]{16,}=*)",
    "private_key": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<value>(?:(?!-----)[\s\S]){24,})",
    "assigned": r"(?i)(?P<name>[\w.-]*" + _NAME + r"[\w-]*)[\"'`]?\]?\s*(?::\s*(?:[A-Za-z_][\w.\[\] |]*)?\s*=(?!=)|=>|:=|=(?!=)|:)\s*(?:(?:[\w.]+\s*\(|[\w.]+\s*\[)\s*[\"'`][\w.-]+[\"'`]\s*\]?\s*(?:,|\)?\s*\|\||\?\?|\s+or\s)\s*|[\w.]+\s*(?:\|\||\?\?|\s+or\s)\s*)?\(?\s*[rbuf]{0,2}(?P<q>[\"'`])(?P<value>(?:(?!(?P=q))[^\n\\]|\\.){4,})(?P=q)",
    "flag": r"(?i)--(?P<name>[\w-]*" + _NAME + r"[\w-]*)(?:=|\s+)[\"']?(?P<value>[^\s'\"`]{6,})",
    "bare": r"(?im)^[ \t]*(?:(?:#|//|\*|--|;|-)\s*)?(?:export\s+|set\s+|ENV\s+|-\s+)?(?P<name>[\w.-]*" + _NAME + r"[\w-]*)\s*[=:]\s*(?P<value>[^\s'\"`(){}\[\],;<>|]{6,})[ \t]*(?:#.*)?$",
    "prose": r"(?i)(?P<name>[\w-]*" + _NAME + r"[\w-]*)\s+(?:is|was)\s+`?[\"'`](?P<value>[^\s'\"`]{6,})[\"'`]",
    "login": r"(?i)\b(?:login|logon|account|access|credentials?|creds|user(?:name)?)\s*[:=]\s*[\w.@-]{2,60}\s*(?:/|:|\s)\s*(?P<value>[^\s'\"`<>]{8,})",
    "table": r"(?im)\|[ \t]*[`*]{0,2}(?P<name>[\w.-]*" + _NAME + r"[\w-]*)[`*]{0,2}[ \t]*\|[ \t]*[`*]{0,2}(?P<value>[^\s|`*]{6,})[`*]{0,2}[ \t]*(?:\||$)",
    "remark": r"(?im)(?:#|//|/\*|\*|<!--)[^\n]{0,120}?\b(?P<name>[\w-]*" + _NAME + r"[\w-]*)\s*(?:is\s|was\s|[=:])\s*[\"'`]?(?P<value>[^\s'\"`(){}\[\],;<>|]{8,})",
}
_COMPILED = {k: re.compile(v) for k, v in PATTERNS.items()}
#: The patterns up to their values.
_HEADS = {k: re.compile(v[: v.index("(?P<value>")]) for k, v in PATTERNS.items()}
_MARKER, _REMARK_TAIL = re.compile(r"#|//|/\*|\*|<!--"), re.compile("(?i)" + PATTERNS["remark"][PATTERNS["remark"].index("\\b(?P<name>") :])

_ANCHOR = re.compile(
    r"(?P<name>pass|pwd|pw(?![a-z])|kennwort|contrase|senha|haslo|heslo|parola|losenord|lykilord|sifre|secret|api[_-]?key|access[_-]?key|signing[_-]?key|private[_-]?key|service[_-]?key|encryption[_-]?key|account[_-]?key|deploy[_-]?key|master[_-]?key|auth[_-]?key|token|credential)"
    r"|(?P<key>sk_live_|sk_test_|rk_live_|ghp_|gho_|ghu_|ghs_|ghr_|github_pat_|glpat-|xox[abeprs]-|akia|asia|aiza|npm_|pypi-|sg\.)"
    r"|(?P<jwt>eyj)|(?P<url>://)|(?P<basic>basic\s)|(?P<bearer>bearer\s)|(?P<pem>-----begin )|(?P<login>(?:login|logon|account|access|credentials?|creds|user(?:name)?)\s*[:=])"
)
_WORD = re.compile(r"[\w.-]+")
#: What can follow a secret's name: an assignment, "is", or a value with a digit.
_FOLLOWED = re.compile(r"[\"'`]?\]?(?:[`*]{0,2}[ \t]*\||\s*[:=]|\s+(?:is|was)\b|\s+[\"']?[^\s\"']*\d)")
_KINDS_OF = {"name": ("assigned", "flag", "bare", "prose", "table", "remark", "connection"), "key": ("provider_key",), "jwt": ("web_token",), "url": ("url",), "basic": ("basic",), "bearer": ("bearer",), "pem": ("private_key",), "login": ("login",)}

#: Words a secret's name ends in, and words that make a key one.
_LAST = {"password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "credential", "credentials", "accesskey", "secretkey", "passwort", "pass", "pw", "passe", "kennwort", "contrasena", "contraseña", "senha", "haslo", "heslo", "parola", "losenord", "lykilord", "sifre"}
_KEY_OF = {"api", "access", "secret", "signing", "private", "service", "encryption", "account", "deploy", "master", "auth", "storage", "billing", "cloud", "pay", "license"}
#: Words that stand before a secret's name without a mark between.
_OWNERS = {"client", "app", "user", "db", "database", "admin", "root", "refresh", "bearer", "session", "bot", "webhook", "shared", "consumer", "jwt", "smtp", "redis", "mysql", "postgres", "mongo", "ssh"}
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.#_\-0]+|(?:x{2,}[-_.]?)+|<.*>?|\$.*|%.*%|\{.*|.*\$\{.*|.*\{\{.*|your[-_ ]?.*|.*change[-_ ]?me.*|.*replace[-_ ]?me.*|.*example.*|dummy.*|placeholder.*|todo.*|none|null|undefined|true|false|"
    r"(?:my[-_]?)?(?:pass|password|passwd|secret|token|user|username|api[-_]?key|key|credentials?|pwd|changeit|redacted.*|hidden|masked)[-_]?(?:here)?|insert.*|fill.*|enter.*|(?:vault|env|ref|ssm|arn|secret|secrets|file|kms|aws|gcp|op)[:/].*|process\.env.*|os\.(?:environ|getenv).*|https?://.*|\.{0,2}/(?![A-Za-z0-9+/]{24,}={0,2}$).*)$"
)
_NO_SECRET = re.compile(r"(?i)^(?:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|(?:sha\d+|md5)[-:].*|\d[\d._:-]*|abcdefgh.*|0123456789.*)$")


def _is_secret_name(name: str) -> bool:
    words = [w for w in re.split(r"[_.\-]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower().rstrip("0123456789_-")) if w]
    if not words:
        return False
    if words[-1] in ("wd", "w") and len(words) > 1 and words[-2].endswith("p"):
        words[-2:] = [words[-2] + words[-1]]
    last = words[-1].rstrip("0123456789")
    if last in _LAST or len(words) == 1 and any(last.endswith(w) and last[: -len(w)] in _KEY_OF | _OWNERS for w in _LAST):
        return "public" not in words and not (last == "token" and words[:-1] and words[-2] in {"max", "min", "next", "page", "csrf", "num"})
    return last == "key" and any(w in _KEY_OF for w in words[:-1])


def _usable(value: str, strict: bool) -> bool:
    """Whether a value can be a secret: no placeholder, and mixed enough."""
    if _PLACEHOLDER.match(value) or _NO_SECRET.match(value) or any(c.isspace() for c in value):
        return False
    if len(set(value)) < 5:
        return False
    digit, lower, upper = (any(f(c) for c in value) for f in (str.isdigit, str.islower, str.isupper))
    other = any(not c.isalnum() and c not in "_-." for c in value)
    kinds = digit + lower + upper + other
    if strict:
        return kinds >= 2 and digit and len(value) >= 8
    return (kinds >= 3 or (kinds == 2 and (digit or len(value) >= 12))) and len(value) >= 6


def _shuffled(value: str) -> bool:
    """Whether letters change between small and capital as they do in no word; enough where a place is a password's own."""
    return len(value) >= 8 and sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:], strict=False)) >= 3 and not _PLACEHOLDER.match(value)


_ADDED = re.compile(r"[\"'`]?\s*\+?\s*([\"'`])([^\"'`\n]{2,})\1")


def _joined(text: str, end: int) -> list[tuple[int, int]]:
    """Spans of the string literals added behind one that ends at end."""
    out = []
    while m := _ADDED.match(text, end):
        out.append(m.span(2))
        end = m.end()
    return out


def find_secrets(text: str, suffix: str = "") -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secret values in a file, in order, without overlaps."""
    low, found, seen, done, counted = text.lower(), [], set(), 0, 0
    for hit in _ANCHOR.finditer(low):
        done, counted = max([done, *(b for _, b, _ in found[counted:])]), len(found)
        if hit.start() < done:  # inside a value that goes as a whole
            continue
        if hit.lastgroup == "name":
            whole = _WORD.search(text, max(0, text.rfind(" ", 0, hit.start()) + 1, hit.start() - 60), hit.end() + 60)
            while whole and whole.end() < hit.end():
                whole = _WORD.search(text, whole.end(), hit.end() + 60)
            if low.startswith("account", hit.start()) and low.startswith("=", hit.end()) or low.startswith("pwd=", hit.start()) or low.startswith("password=", hit.start()):
                pass
            elif not whole or not _is_secret_name(whole.group()) or not _FOLLOWED.match(low, whole.end()):
                continue
        line = text.rfind("\n", 0, hit.start()) + 1
        begin = max(line, hit.start() - 160)
        end = text.find("\n", hit.end())
        end = len(text) if end < 0 else end
        for kind in _KINDS_OF[hit.lastgroup]:
            # Heads are looked for near the anchor; a match runs to the end of its own value.
            reach = min(max(end, hit.end()) + 200, hit.end() + 700, len(text))
            for at in _places(kind, hit, whole if hit.lastgroup == "name" else None, text, begin, reach):
                if (kind, at) in seen:
                    continue
                seen.add((kind, at))
                if m := _COMPILED[kind].match(text, at):
                    found += _judge(kind, m, text, suffix)
            if kind == "remark" and whole and (kind, whole.start(), "") not in seen and _MARKER.search(text, max(line, whole.start() - 120), whole.start()):
                seen.add((kind, whole.start(), ""))
                if m := _REMARK_TAIL.match(text, whole.start()):
                    found += _judge(kind, m, text, suffix)
    out: list[tuple[int, int, str]] = []
    rank = {k: i for i, k in enumerate(PATTERNS)}
    for span in sorted(set(found), key=lambda x: (x[0], -x[1], rank.get(x[2], len(rank)))):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
        elif span[1] > out[-1][1]:
            out.append((out[-1][1], span[1], "continued"))
    return out


def _places(kind: str, hit: re.Match, whole: re.Match | None, text: str, begin: int, reach: int) -> Iterator[int]:
    """Where a match of the kind that holds the anchor or lies before it on the line can begin."""
    if kind in ("provider_key", "web_token"):
        yield hit.start()
        return
    at = begin
    while (head := _HEADS[kind].search(text, at, reach)) and head.start() <= hit.end():
        yield head.start()
        # A head can hold two names of which the first has no value: go on behind its first word.
        word = _WORD.match(text, head.start())
        at = word.end() if word else head.start() + 1


def _judge(kind: str, m: re.Match, text: str, suffix: str) -> list[tuple[int, int, str]]:
    """The match's span if its value can be used."""
    value, found = m.group("value"), [(*m.span("value"), kind)]
    if kind == "private_key":
        body = re.sub(r"\\n|[^A-Za-z0-9+/=]", "", value)
        if len(body) >= 40 and len(set(body)) > 12:
            return [(m.start(), m.end(), kind)]
        return []
    if "name" in m.re.groupindex and not _is_secret_name(m.group("name")):
        return []
    if kind == "basic":
        try:
            plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
        except (binascii.Error, UnicodeDecodeError):
            return []
        user, colon, word = plain.partition(":")
        if not colon or not plain.isprintable() or not (_usable(word, False) or _shuffled(word)):
            return []
    elif kind in ("provider_key", "web_token"):
        if len(set(value[8:])) < 6 or "EXAMPLE" in value:
            return []
    elif kind == "assigned":
        added = _joined(text, m.end())
        if not _usable(value + "".join(text[a:b] for a, b in added), False):
            return []
        found += [(a, b, "continued") for a, b in added]
    elif kind in ("bare", "flag", "remark", "bearer", "prose", "table", "login"):
        if suffix in ("py", "ts", "tsx", "js", "jsx") and kind == "bare" and not re.match(r"[ \t]*(?:#|//|\*|--)", m.group()):
            return []
        if not _usable(value, True) and not (kind == "prose" and _usable(value, False)):
            return []
    elif not _usable(value, False) and not (kind in ("url", "connection") and _shuffled(value)):
        return []
    return found


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every value replaced; quotes, line breaks and all else stay."""
    parts, at = [], 0
    for a, b, kind in spans:
        value = text[a:b]
        if kind == "private_key":
            head = value.index("-----", 5) + 5
            new = value[:head] + re.sub(r"[A-Za-z0-9+/=]{8,}", "REDACTED", value[head:])
        else:
            new = "REDACTED"
        parts += [text[at:a], new]
        at = b
    return "".join(parts) + text[at:]


# Required trigrams of a pattern ------------------------------------------------------------


def _exact(node, most: int = 64) -> set[str] | None:
    """The strings a node can match, lower case, if they are few and fixed."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()} if arg < 128 else None
    if op == "IN":
        return {chr(v).lower() for _, v in arg} if len(arg) <= 24 and all(str(o) == "LITERAL" and v < 128 for o, v in arg) else None
    if op == "SUBPATTERN":
        return _exact_all(arg[-1], most)
    if op == "BRANCH":
        each = [_exact_all(b, most) for b in arg[1]]
        return None if None in each or len(out := set().union(*each)) > most else out
    if op in ("MAX_REPEAT", "MIN_REPEAT") and tuple(arg[:2]) == (0, 1) and (one := _exact_all(arg[2], most)):
        return one | {""}
    return None


def _exact_all(nodes, most: int) -> set[str] | None:
    out = {""}
    for n in nodes:
        each = _exact(n, most)
        if each is None or len(out) * len(each) > most:
            return None
        out = {a + b for a, b in product(out, each)}
    return out


def _alternatives(nodes, most: int = 400) -> set[frozenset[str]]:
    """Sets of trigrams, lower case, one of which every match contains whole."""
    parts: list[set[frozenset[str]]] = []
    runs = {""}

    def close() -> None:
        nonlocal runs
        parts.append({frozenset(r[i : i + 3] for i in range(len(r) - 2)) for r in runs})
        runs = {""}

    for node in nodes:
        op, arg = str(node[0]), node[1]
        if op == "ASSERT" and arg[0] == 1 and (each := _exact_all(arg[1], 64)) and len(runs) * len(each) <= 64:
            runs = {a + b for a, b in product(runs, each)}
            close()
            continue
        if op in ("ASSERT", "ASSERT_NOT", "AT"):
            continue
        each = _exact(node)
        if each is not None and len(runs) * len(each) <= 64:
            runs = {a + b for a, b in product(runs, each)}
            continue
        close()
        if each is not None:
            runs = each
        elif op == "SUBPATTERN":
            parts.append(_alternatives(arg[-1], most))
        elif op == "BRANCH":
            parts.append(set().union(*(_alternatives(b, most) for b in arg[1])))
        elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            parts.append(_alternatives(arg[2], most))
    close()
    best: set[frozenset[str]] = {frozenset()}
    for p in sorted(parts, key=len):
        if frozenset() in p:
            continue
        if len(best) * len(p) <= most:
            best = {a | b for a, b in product(best, p)}
        elif frozenset() in best:
            best = p
    return best


@lru_cache(maxsize=64)
def required(kind: str) -> tuple[frozenset[str], ...]:
    found = _alternatives(re._parser.parse(PATTERNS[kind]))
    return tuple(a for a in found if not any(b < a for b in found))


@lru_cache(maxsize=1)
def trigrams() -> list[str]:
    return sorted(set().union(*(a for k in PATTERNS for a in required(k))))


@lru_cache(maxsize=1)
def _plan() -> tuple[np.ndarray, np.ndarray]:
    """(trigrams x sets matrix, size of each set) over all patterns."""
    number = {g: i for i, g in enumerate(trigrams())}
    sets = sorted({a for k in PATTERNS for a in required(k)}, key=sorted)
    holds = np.zeros((len(number), len(sets)), dtype=np.float32)
    for n, a in enumerate(sets):
        holds[[number[g] for g in a], n] = 1
    return holds, holds.sum(axis=0)


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of a block of chunks as a bitmap of chunks by trigrams, intersected with the sets of the patterns."""
    grams = trigrams()
    lookup = np.zeros(1 << 21, dtype=np.uint16)
    for i, g in enumerate(grams, 1):
        a, b, c = g.encode()
        lookup[a << 14 | b << 7 | c] = i
    lower = np.arange(256, dtype=np.uint32)
    lower[65:91] += 32
    lower[128:] = 0
    holds, sizes = _plan()
    for batch in batches:
        text = batch.column(2).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        for low in range(0, len(text), 1024):
            off = offsets[low : low + 1025] - offsets[low]
            data = lower[np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[low] : offsets[low] + off[-1]]]
            if len(data) < 3:
                continue
            hit = lookup[data[:-2] << 14 | data[1:-1] << 7 | data[2:]]
            at = np.flatnonzero(hit)
            row = np.searchsorted(off, at, side="right") - 1
            inside = at + 3 <= off[row + 1]
            bitmap = np.zeros((len(off) - 1, len(grams)), dtype=np.float32)
            bitmap[row[inside], hit[at[inside]] - 1] = 1
            found = pa.array(low + np.flatnonzero((bitmap @ holds >= sizes).any(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(found), batch.column(1).take(found)], ["repo_id", "file_path"])


def candidates(chunks: DataFrame) -> DataFrame:
    """(repo_id, file_path) of the files with a chunk that holds a whole set of trigrams of a pattern."""
    rows = chunks.where("content IS NOT NULL AND file_path IS NOT NULL").select("repo_id", "file_path", "content")
    return rows.mapInArrow(_intersect, "repo_id string, file_path string").distinct()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for repo, path, text in zip(pdf["repo_id"], pdf["file_path"], pdf["text"], strict=True):
            spans = find_secrets(text, path.rpartition(".")[2].lower())
            if spans:
                begun = [x for x in spans if x[2] != "continued"]
                lines = [text.count("\n", 0, a) + 1 for a, _, _ in begun]
                out.append((repo, path, lines, [k for _, _, k in begun], redact(text, spans)))
        yield pd.DataFrame(out, columns=["repo_id", "file_path", "lines", "kinds", "redacted"])


def secrets(chunks: DataFrame) -> DataFrame:
    """(repo_id, file_path, lines, kinds, redacted) of every file with a secret.

    lines and kinds list the secrets in order, lines being 1-based lines of the whole
    file, and redacted is the file's text with their values replaced.  Chunks with null
    content or path have none; repeated rows and second ingests count once.
    """
    # Joined on the columns that files are grouped by, so the contents are shuffled once; U+0000 stands for a null repo_id.
    known = chunks.withColumn("repo_id", F.coalesce("repo_id", F.lit("\0")))
    files = assemble(known.join(candidates(known), ["repo_id", "file_path"], "left_semi"))
    return files.withColumn("repo_id", F.nullif("repo_id", F.lit("\0"))).mapInPandas(_verify, "repo_id string, file_path string, lines array<int>, kinds array<string>, redacted string")
