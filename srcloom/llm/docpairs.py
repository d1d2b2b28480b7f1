"""Functions paired with their documentation.

Files are put together and scanned once: literals and comments are masked, definitions
are found in what is left and documentation is read where the language puts it.
Methods without documentation of their own inherit it: classes and their bases are
joined upwards, round by round, until a documented method of the same name is found.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm.files import assemble
from srcloom.runtime import cut

LEAST_WORDS = 4

_PY_MASK = re.compile(r'#[^\n]*|(?:\b[rRbBuUfF]{1,2})?(?:"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\')', re.S)
_PY_DEF = re.compile(r"^([ \t]*)(?:(async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*(?:\[[^\]\n]*\])?[ \t]*\(|class[ \t]+([^\W\d]\w*)[ \t]*(?:\[[^\]\n]*\])?[ \t]*(\(|:))", re.M)
_PY_DOC = re.compile(r'([rRuU]?)("""|\'\'\'|"|\')')
_JS_MASK = re.compile(
    r"/\*[\s\S]*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
    r"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`(?:[^`\\]|\\[\s\S])*`|\{[^{}]*\})*\})*`"
    r"|[(,=:\[!&|?{};+]\s*(/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"
)
_MODS = r"(?:(?:export|default|declare|public|private|protected|static|async|override|readonly|get|set)\s+)*"
_JS_FUNC = re.compile(r"[ \t]*" + _MODS + r"function\b\s*\*?\s*([\w$]+)\s*")
_JS_CONST = re.compile(r"[ \t]*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=\n]*(?:=>[^=\n]*)?)?=(?!=)\s*(async\b\s*)?(function\b|(?=[(<])|[\w$]+\s*=>)")
_JS_METHOD = re.compile(r"[ \t]*" + _MODS + r"\*?\s*(#?[\w$]+)\s*\??\s*(?=[(<])")
_JS_CLASS = re.compile(r"\b(?:class|interface)\s+([\w$]+)([^{]*)\{")
_JS_BASES = re.compile(r"\b(?:extends|implements)\s+([\w$.\s,]+?)(?=\s*(?:\bimplements\b|$))")
#: A method without a body, in an interface or an abstract class.
_JS_SIGNATURE = re.compile(r"[ \t]*(?:(?:public|protected|abstract|readonly|async|static)\s+)*([\w$]+)\??\s*(?:[(<]|:\s*(?:\(|<))")
_NOT_METHOD = {"if", "for", "while", "switch", "catch", "return", "function", "with", "await", "typeof", "new", "super", "do", "else", "throw", "import"}
_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"\s*[:@][^\W\d_]")
_SECTION = re.compile(r"\s*(?:Args|Returns|Raises):")


def words(doc: str) -> int:
    """Words of a documentation text outside tag lines and Args, Returns and Raises sections."""
    n, inside = 0, False
    for line in doc.split("\n"):
        if not line.strip():
            inside = False
        elif _SECTION.match(line):
            inside = True
        if not inside and not _TAG.match(line):
            n += len(_WORD.findall(line))
    return n


def _mask(pattern: re.Pattern, text: str) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The text with literals and comments blanked, places kept; the spans of /** */ comments; the line breaks inside literals."""
    parts, at, docs, inside = [], 0, [], []
    for m in pattern.finditer(text):
        a, b = m.span(1) if pattern is _JS_MASK and m.group(1) else m.span()
        s = text[a:b]
        if s.startswith("/**") and len(s) > 4:
            docs.append((a, b))
        mark = " " if s[0] == "#" or s[:2] in ("//", "/*") else "_"
        parts += [text[at:a], "\n".join(mark * len(x) for x in s.split("\n")) if "\n" in s else mark * len(s)]
        if mark == "_" and "\n" in s:
            inside += [a + k for k, c in enumerate(s) if c == "\n"]
        at = b
    return "".join(parts) + text[at:], docs, inside


_BRACKET = re.compile(r"[()\[\]{}]")


def _closes(masked: str) -> dict[int, int]:
    """Position behind the closing bracket of every bracket that is closed."""
    stack, out = [], {}
    for m in _BRACKET.finditer(masked):
        if m.group() in "([{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def _starts(masked: str, inside: list[int], closes: dict[int, int]) -> list[tuple[int, int]]:
    """(place, indentation) of the logical lines of a Python file that hold code."""
    joined = set(inside)
    at = 0
    for a, b in sorted(closes.items()):
        if b > at:
            at = max(a, at)
            while 0 <= (at := masked.find("\n", at, b)):
                joined.add(at)
                at += 1
            at = b
    out = []
    for m in re.finditer(r"^[ \t\f]*(?=\S)", masked, re.M):
        if m.start() - 1 not in joined and not masked.endswith(("\\\n", "\\\r\n"), 0, m.start()):
            out.append((m.start(), len(m.group().rpartition("\f")[2].expandtabs())))
    return out


def _python_end(text: str, masked: str, starts: list[tuple[int, int]], head: int, width: int) -> int:
    """Position behind the last line of a function's body, comments of its indentation included."""
    k = bisect_left(starts, (head, 0))
    while k < len(starts) and starts[k][1] > width:
        k += 1
    stop = starts[k][0] if k < len(starts) else len(text)
    end = text.find("\n", head + len(masked[head:stop].rstrip()))
    end = at = len(text) if end < 0 else end
    while at < stop:
        line_end = text.find("\n", at + 1)
        line_end = len(text) if line_end < 0 else line_end
        line = text[at + 1 : line_end]
        if line.strip():
            if len(line.expandtabs()) - len(line.expandtabs().lstrip()) <= width:
                break
            end = line_end
        at = line_end
    return end


def _angle(masked: str, at: int, closes: dict[int, int]) -> int:
    """Position behind a type parameter list at at."""
    if not masked.startswith("<", at):
        return at
    depth, k = 0, at
    while m := re.compile(r"=>|[<>(\[{;)\]}]").search(masked, k):
        mark, k = m.group(), m.end()
        if mark in "([{":
            k = closes.get(m.start(), -1)
        if k < 0 or mark in ";)]}":
            return at
        depth += (mark == "<") - (mark == ">")
        if depth == 0:
            return k
    return at


_PY_FROM = re.compile(r"^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(\([^)]*\)|(?:[^\n;\\]|\\\r?\n)*)", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*import[ \t]+([^\n;]+)", re.M)
_JS_IMPORT = re.compile(r"^[ \t]*import\s+(?:type\s+)?([\w$*\s{},]+?)\s*from\s*['\"]([^'\"\n]+)['\"]|\b(?:const|let|var)\s+(\{[^{}]*\}|[\w$]+)\s*=\s*require\(\s*['\"]([^'\"\n]+)['\"]\s*\)", re.M)


def _python_imports(masked: str) -> tuple[dict[str, tuple[str, str | None]], list[str]]:
    """Local names of a Python file's imports, as (module, name in it or None), and modules imported with a star."""
    names, stars = {}, []
    for m in _PY_IMPORT.finditer(masked):
        for part in m.group(1).split(","):
            words_ = part.split()
            if len(words_) == 3 and words_[1] == "as":
                names[words_[2]] = (words_[0], None)
    for m in _PY_FROM.finditer(masked):
        for part in re.sub(r"[()\\]", " ", m.group(2)).split(","):
            words_ = part.split()
            if words_ == ["*"]:
                stars.append(m.group(1))
            elif words_:
                names[words_[-1]] = (m.group(1), words_[0])
    return names, stars


def _js_imports(text: str, masked: str) -> dict[str, tuple[str, str | None]]:
    """As _python_imports; a default import is taken for the class of its name."""
    names = {}
    for m in _JS_IMPORT.finditer(text):
        at = m.start(1) if m.group(1) else m.start(3)
        if masked[at] != text[at]:
            continue
        what, module = (m.group(1), m.group(2)) if m.group(1) else (m.group(3), m.group(4))
        for part in re.sub(r"[{}]", ",", what.replace(":", " as ")).split(","):
            words_ = [x for x in part.split() if x != "type"]
            if len(words_) == 3:
                names[words_[2]] = (module, None if words_[0] == "*" else words_[0])
            elif len(words_) == 1:
                names[words_[0]] = (module, words_[0] if "{" in what or m.group(1) else None)
    return names


def _reference(base: str, names: dict, stars: list[str], slash: str) -> tuple[str, str, list[str]]:
    """(name in this file, name where it is defined, modules that can define it) of a base class."""
    *qualifier, name = base.split(".")
    join = lambda module, rest: slash.join([module] * bool(module) + rest) if not module.endswith(".") else module + slash.join(rest)
    if not qualifier:
        if name not in names:
            return name, name, stars
        module, there = names[name]
        return name, there or name, [module]
    if qualifier[0] not in names:
        return name, name, [slash.join(qualifier)] if slash == "." else []
    module, there = names[qualifier[0]]
    return name, name, [join(module, [there] * bool(there) + qualifier[1:]), *[module] * bool(there)]


def _folded(parts: list[str]) -> str:
    out: list[str] = []
    for x in parts:
        if x == "..":
            out[-1:] = []
        elif x not in ("", "."):
            out.append(x)
    return "/".join(out)


def _stem(path: str) -> str:
    return re.sub(r"(?:\.d)?\.(?:pyi?|[cm]?[jt]sx?)$", "", path, flags=re.I)


def _keys_of(path: str) -> list[str]:
    """Keys under which the classes of a file are known: its path, its module, every tail of that, its folders, and none."""
    module = _folded(_stem(path).split("/"))
    modules = [module, *[module.rpartition("/")[0]] * (module.rpartition("/")[2] in ("__init__", "index"))]
    folders = module.split("/")[:-1]
    out = ["=" + path, *("/" + x for x in modules), *("/".join(p[k:]) for x in modules for p in [x.split("/")] for k in range(len(p)))]
    return list(dict.fromkeys([*out, *("/" + "/".join(folders[: k + 1]) + "/" for k in range(len(folders))), ""]))


def _keys_for(path: str, here: str, modules: list[str], same: bool) -> list[str]:
    """Keys to look a base up under, best first: this file, its modules, files inside them, the repository."""
    folder = path.split("/")[:-1]
    out, inside = ["=" + path] if same else [], []
    for module in modules:
        if path.lower().endswith(".py"):
            dots = len(module) - len(module.lstrip("."))
            parts = [x for x in module.split(".") if x]
            if dots:
                exact, tail = [_folded([*folder, *[".."] * (dots - 1), *parts])], None
            else:
                exact, tail = [_folded([*folder[:k], *parts]) for k in range(len(folder), -1, -1)], "/".join(parts)
        elif module.startswith("."):
            exact, tail = [_folded([*folder, *_stem(module).split("/")])], None
        else:
            tail = _stem(module.removeprefix("@/").removeprefix("~/"))
            exact = [tail]
        out += ["/" + x for x in exact] + [tail] * bool(tail)
        inside += [f"/{x}/" for x in exact if x]
    return list(dict.fromkeys([*out, *inside, ""]))


def python_functions(text: str) -> tuple[list[tuple], list[tuple]]:
    """Functions (name, line, kind, class, doc, start, end) and classes (name, bases) of a Python file."""
    masked, _, inside = _mask(_PY_MASK, text)
    closes = _closes(masked)
    starts = _starts(masked, inside, closes)
    functions, classes, stack = [], [], []
    found = list(_PY_DEF.finditer(masked))
    for m in found:
        width = len(m.group(1).expandtabs())
        while stack and stack[-1][0] >= width:
            stack.pop()
        if m.group(4):
            bases = []
            if m.group(5) == "(":
                end = closes.get(m.end() - 1, -1)
                bases = [re.sub(r"\s", "", b) for b in re.sub(r"\[[^\]]*\]", "", masked[m.end() : max(end - 1, m.end())]).split(",") if "=" not in b and b.strip()]
            classes.append((m.group(4), bases))
            stack.append((width, m.group(4), True))
            continue
        owner = stack[-1][1] if stack and stack[-1][2] else None
        stack.append((width, m.group(3), False))
        name_at = m.start(3)
        end = closes.get(m.end() - 1, -1)
        if end < 0:
            continue
        colon = re.compile(r"[^:\n\[{(]*(?:[\[{(][^:]*?[\]})][^:\n\[{(]*)*:").match(masked, end)
        head = colon.end() if colon else end
        first = re.compile(r"\s*").match(masked, head).end()
        doc = None
        d = _PY_DOC.match(text, first) if colon else None
        if d and masked[first : first + 1] == "_":
            same_line = "\n" not in masked[head:first]
            column = len(text[text.rfind("\n", 0, first) + 1 : first].expandtabs())
            lit = _PY_MASK.match(text, first)
            if lit and (same_line or column > width) and re.compile(r"[ \t]*(?:;|\r?\n|$)").match(masked, lit.end()):
                raw = lit.group()[len(d.group()) : -len(d.group(2))]
                doc = raw
                if "\\" in raw and d.group(1) not in ("r", "R"):
                    try:
                        doc = ast.literal_eval(lit.group())
                    except (SyntaxError, ValueError):
                        pass
        functions.append((m.group(3), text.count("\n", 0, name_at) + 1, "method" if owner else "function", owner, doc, m.start(), _python_end(text, masked, starts, head, width)))
    names, stars = _python_imports(masked) if any(bases for _, bases in classes) else ({}, [])
    return functions, [(c, [_reference(b, names, stars, ".") for b in bases]) for c, bases in classes]


_TYPE_PART = re.compile(r"=>|[(\[{<;})\],]")
#: What a type goes on after: a brace behind it belongs to the type.
_TYPE_OPEN = re.compile(r"(?:[:|&?]|=>|\b(?:is|extends|keyof|readonly|asserts|infer))\s*$")
_PARAMETERS = re.compile(r"\s*(?:\)|\.\.\.|[\w$]+\s*\??\s*:|[{\[][^{}\[\]]*[}\]]\s*:)")
_GOES_ON = re.compile(r"\s*(?:[.?:+\-*/%=&|<>,(\[^]|!=|(?:in|instanceof|as|satisfies)\b)")
_OPEN_END = re.compile(r"(?:[.?:+\-*/%=&|<,^!~]|=>|\b(?:await|new|typeof|void|in|instanceof|as|return|delete))$")


def _behind_type(masked: str, at: int, closes: dict[int, int]) -> tuple[str, int] | None:
    """('{' or '=>', its place) that follows a parameter list and its return type, if any."""
    at = re.compile(r"\s*").match(masked, at).end()
    if not masked.startswith(":", at):
        return ("{", at) if masked.startswith("{", at) else ("=>", at) if masked.startswith("=>", at) else None
    begin = at
    while m := _TYPE_PART.search(masked, at):
        mark, a = m.group(), m.start()
        opens = _TYPE_OPEN.search(masked, max(begin, a - 40), a)
        if mark == "=>" or mark == "{" and not opens:
            return mark, a
        if mark == "<":
            at = _angle(masked, a, closes)
            if at == a:
                return None
        elif mark in "([{":
            at = closes.get(a, -1)
            if at < 0:
                return None
            # Parameters where a type begins are those of a function type.
            if mark == "(" and opens and _PARAMETERS.match(masked, a + 1) and (arrow := re.compile(r"\s*=>").match(masked, at)):
                at = arrow.end()
        else:
            return None
    return None


def _expression_end(text: str, masked: str, at: int, closes: dict[int, int], inside: set[int]) -> int:
    """Position behind the expression that begins at at."""
    begin = at = re.compile(r"\s*").match(masked, at).end()
    markup = masked.startswith("<", at)
    while m := re.compile(r"[(\[{)\]};,\n]").search(masked, at):
        a = m.start()
        if m.group() in "([{":
            at = closes.get(a, len(masked))
            continue
        if m.group() != "\n":
            return len(masked[begin:a].rstrip()) + begin
        at = a + 1
        before = masked[max(begin, a - 200) : a].rstrip()
        if a in inside or _OPEN_END.search(before) or markup and before.endswith(">"):
            continue
        if not before and not masked[begin:a].strip() or _GOES_ON.match(masked, at):
            continue
        following = re.compile(r"\s*").match(masked, at).end()
        if text.startswith("`", following):
            continue
        return len(masked[begin:a].rstrip()) + begin
    return len(masked.rstrip())


def _js_target(masked: str, at: int, closes: dict[int, int]) -> tuple[str, int, int, str] | None:
    """(name, place of the name, place of the body, kind) of a function that begins on the line at at."""
    if m := _JS_FUNC.match(masked, at):
        kind, name, at_name, p = "function", m.group(1), m.start(1), _angle(masked, m.end(), closes)
    elif m := _JS_CONST.match(masked, at):
        name, at_name = m.group(1), m.start(1)
        if m.group(3).endswith("=>"):
            return name, at_name, m.end(), "function"
        if m.group(3):
            p = _angle(masked, re.compile(r"\s*\*?\s*[\w$]*\s*").match(masked, m.end()).end(), closes)
            if not masked.startswith("(", p):
                return None
            behind = _behind_type(masked, closes.get(p, p), closes)
            return name, at_name, behind[1] if behind else p, "function"
        p = closes.get(re.compile(r"\s*").match(masked, _angle(masked, m.end(), closes)).end(), -1)
        behind = _behind_type(masked, p, closes) if p > 0 else None
        return (name, at_name, behind[1] + 2, "function") if behind and behind[0] == "=>" else None
    elif (m := _JS_METHOD.match(masked, at)) and m.group(1) not in _NOT_METHOD:
        kind, name, at_name, p = "method", m.group(1), m.start(1), _angle(masked, m.end(), closes)
    else:
        return None
    p = closes.get(p, -1) if masked.startswith("(", p) else -1
    behind = _behind_type(masked, p, closes) if p > 0 else None
    return (name, at_name, behind[1], kind) if behind and behind[0] == "{" else None


def _js_bases(head: str) -> list[str]:
    """Classes and interfaces a class's head names, in order; type arguments are left out."""
    while (plain := re.sub(r"<[^<>]*>", "", head)) != head:
        head = plain
    return [b.strip() for m in _JS_BASES.finditer(head.rstrip()) for b in m.group(1).split(",") if b.strip()]


def js_functions(text: str) -> tuple[list[tuple], list[tuple]]:
    """As python_functions, for TypeScript and JavaScript.  Documented methods without a body are of the kind signature."""
    masked, docs, inside = _mask(_JS_MASK, text)
    closes, inside = _closes(masked), set(inside)
    classes, spans = [], []
    for m in _JS_CLASS.finditer(masked):
        end = closes.get(m.end() - 1, -1)
        spans.append((m.start(), end if end > 0 else len(masked), m.group(1)))
        classes.append((m.group(1), _js_bases(m.group(2))))
    documented = {}
    for a, b in docs:
        line = text.find("\n", b)
        if line < 0 or text[b:line].strip():
            continue
        at = line + 1
        while re.compile(r"[ \t]*@[\w$.]+[^\n]*(?:\n|$)").match(masked, at):
            nxt = masked.find("\n", at) + 1
            if not nxt:
                break
            at = nxt
        documented[at] = text[a + 3 : b - 2]
    functions = []
    starts = {0, *documented, *(m.end() for m in re.finditer(r"\n(?=[ \t]*[\w$#@*])", masked))}
    for at in sorted(starts):
        target = _js_target(masked, at, closes)
        if not target:
            sign = _JS_SIGNATURE.match(masked, at) if at in documented else None
            owner = min(((e - s, c) for s, e, c in spans if s < at < e), default=(0, None))[1]
            if sign and owner and sign.group(1) not in _NOT_METHOD:
                doc = "\n".join(re.sub(r"^\s*\*? ?", "", x) for x in documented[at].split("\n")).strip()
                functions.append((sign.group(1), text.count("\n", 0, sign.start(1)) + 1, "signature", owner, doc, at, at))
            continue
        name, place, body, kind = target
        owner = min(((e - s, c) for s, e, c in spans if s < place < e), default=(0, None))[1]
        doc = documented.get(at)
        if doc is not None:
            doc = "\n".join(re.sub(r"^\s*\*? ?", "", x) for x in doc.split("\n")).strip()
        elif kind == "method" and owner is None:
            continue
        opened = re.compile(r"\s*\{").match(masked, body)
        end = closes.get(opened.end() - 1, -1) if opened else _expression_end(text, masked, body, closes, inside)
        functions.append((name, text.count("\n", 0, place) + 1, "method" if owner and kind == "method" else "function", owner, doc, at, end if end > 0 else len(text)))
    names = _js_imports(text, masked) if any(bases for _, bases in classes) else {}
    return functions, [(c, [_reference(b, names, [], "/") for b in bases]) for c, bases in classes]


_FOUND = "repo_id string, file_path string, symbol_name string, start_line int, kind string, class_name string, bases array<struct<here:string,name:string,keys:array<string>>>, keys array<string>, doc string, n_words int, code string"


def _extract(with_code: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, path, text in zip(pdf["repo_id"], pdf["file_path"], pdf["text"], strict=True):
                fs, cs = (python_functions if path.lower().endswith(".py") else js_functions)(text)
                out += [(repo, path, name, line, kind, owner, None, None, doc, words(doc) if doc else 0, text[a:b] if with_code else None) for name, line, kind, owner, doc, a, b in fs]
                keys = _keys_of(path) if cs else []
                out += [(repo, path, name, None, "class", name, [{"here": h, "name": n, "keys": _keys_for(path, h, modules, h != name)} for h, n, modules in bases], keys, None, 0, None) for name, bases in cs]
            yield pd.DataFrame(out, columns=["repo_id", "file_path", "symbol_name", "start_line", "kind", "class_name", "bases", "keys", "doc", "n_words", "code"]).astype({"start_line": "Int32"})

    return run


def _bases(classes: DataFrame) -> DataFrame:
    """(r, at_path, at, pos, base_path, base): the bases of every class, each as the one class it means."""
    one = Window.partitionBy("r", "file_path", "class_name").orderBy(F.to_json(F.struct("bases")))
    first = classes.withColumn("n", F.row_number().over(one)).where("n = 1").select("r", "file_path", "class_name", F.posexplode("bases").alias("pos", "b"))
    wanted = first.select("r", F.col("file_path").alias("at_path"), F.col("class_name").alias("at"), "pos", F.posexplode("b.keys").alias("rank", "key"), "b.here", "b.name")
    wanted = wanted.withColumn("base", F.when(F.col("key").startswith("="), F.col("here")).otherwise(F.col("name"))).drop("here", "name")
    known = classes.select("r", "file_path", F.col("class_name").alias("base"), F.explode("keys").alias("key")).distinct()
    known = known.join(wanted.select("r", "base", "key").distinct(), ["r", "base", "key"], "left_semi")
    # The second counts where a class would be its own base.
    two = Window.partitionBy("r", "base", "key").orderBy("file_path")
    known = known.withColumn("n", F.row_number().over(two)).where("n <= 2").select("r", "base", "key", F.col("file_path").alias("base_path"))
    met = wanted.join(known, ["r", "base", "key"]).where("base != at OR base_path != at_path")
    best = met.groupBy("r", "at_path", "at", "pos").agg(F.min_by(F.struct("base_path", "base"), F.struct("rank", "base_path")).alias("b"))
    return cut(best.select("r", "at_path", "at", "pos", "b.base_path", "b.base"))


def doc_pairs(chunks: DataFrame, least_words: int = LEAST_WORDS, with_code: bool = True) -> DataFrame:
    """Pairs (repo_id, file_path, symbol_name, start_line, kind, code, doc, n_words, doc_from).

    One row per function or method of the Python, TypeScript and JavaScript files whose
    documentation has at least least_words words.  doc_from is 'own', or 'Base.method' for
    documentation inherited from the nearest base class or interface of the repository that
    documents the method.  A base is looked for in the same file, then where imports lead, inside
    an imported package, and only then by its name in the repository, where the smallest
    path counts.  A default import is taken for the class of its name.
    Functions without such documentation are dropped, as are null contents and paths.
    Repeated rows and second ingests give one pair.
    """
    files = assemble(chunks, ("py", "ts", "tsx", "js", "jsx"))
    found = cut(files.mapInPandas(_extract(with_code), _FOUND).distinct())
    functions = found.where("kind != 'class'").drop("bases", "keys")
    own = functions.where(F.col("n_words") >= least_words).withColumn("doc_from", F.lit("own"))
    functions = functions.where("kind != 'signature'")
    key = F.coalesce("repo_id", F.lit(""))
    bases = _bases(found.where("kind = 'class'").withColumn("r", key))
    w = Window.partitionBy("r", "file_path", "class_name", "symbol_name").orderBy("start_line")
    documented = own.where("class_name IS NOT NULL").withColumn("r", key).withColumn("n", F.row_number().over(w)).where("n = 1")
    documented = documented.select("r", F.col("file_path").alias("base_path"), F.col("class_name").alias("base"), "symbol_name", F.col("doc").alias("d"), F.col("n_words").alias("nw"))
    method = ["r", "file_path", "class_name", "symbol_name", "start_line"]
    lacking = functions.where((F.col("n_words") < least_words) & F.col("class_name").isNotNull()).withColumn("r", key).drop("doc", "n_words")
    open_ = lacking.select(*method, F.col("file_path").alias("at_path"), F.col("class_name").alias("at"))
    seen, hits = open_, None
    while True:
        up = open_.join(bases, ["r", "at_path", "at"])
        tried = cut(up.join(documented, ["r", "base_path", "base", "symbol_name"], "left"))
        hit = tried.where("d IS NOT NULL").groupBy(*method).agg(F.min_by(F.struct("d", "nw", "base"), F.struct("pos", "base_path", "base")).alias("b"))
        hits = hit if hits is None else hits.unionByName(hit)
        up = tried.join(hit.select(*method), method, "left_anti").select(*method, F.col("base_path").alias("at_path"), F.col("base").alias("at")).distinct()
        # A method comes to a class once, so circles end.
        open_ = cut(up.join(bases.select("r", "at_path", "at").distinct(), ["r", "at_path", "at"], "left_semi").join(seen, [*method, "at_path", "at"], "left_anti"))
        if open_.isEmpty():
            break
        seen = seen.unionByName(open_)
    inherited = lacking.join(hits, method).select("repo_id", "file_path", "symbol_name", "start_line", "kind", "class_name", F.col("b.d").alias("doc"), F.col("b.nw").alias("n_words"), "code", F.concat("b.base", F.lit("."), "symbol_name").alias("doc_from"))
    result = own.where("kind != 'signature'").unionByName(inherited)
    return result.select("repo_id", "file_path", "symbol_name", "start_line", "kind", "code", "doc", "n_words", "doc_from").distinct()
