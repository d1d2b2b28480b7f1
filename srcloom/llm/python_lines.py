"""Python files as token rows: lexed whole batches at a time, statements reduced window by window.

A file's tokens come from one regular expression and are turned into numbers by a table,
so that everything but the indentation of lines is array work.  A logical line is then a
string of one letter per token.  Its brackets are reduced from the inside outwards: what
a pair of brackets holds is a flat window without brackets, a regular language, and gives
the set of roles the group can play outside (expression, target, arguments, parameters
and so on).  A line that is left flat has to be a statement.  Lines of equal letters are
reduced once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

_TRIPLE = r"\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*+'''"
_SINGLE = r"\"(?!\"\")(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*+\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*+'"
# A field of a formatted string may hold strings of any quote and, for its format, fields of its own.
_QUOTED = r"\"[^\"\n]*\"|'[^'\n]*'"
_FIELD = rf"\{{(?!\{{)(?:[^{{}}'\"\n]|{_QUOTED}|\{{(?:[^{{}}'\"\n]|{_QUOTED}|\{{[^{{}}\n]*\}})*+\}})*+\}}"
_FORMATTED = rf"\"(?!\"\")(?:[^\"\\\r\n{{]|\\(?:\r\n|[\s\S])|\{{\{{|{_FIELD})*+\"|'(?!'')(?:[^'\\\r\n{{]|\\(?:\r\n|[\s\S])|\{{\{{|{_FIELD})*+'"
_DIGITS = r"[0-9](?:_?[0-9])*+"
_EXP = rf"[eE][+-]?{_DIGITS}"
_NUMBER = rf"0[xX](?:_?[0-9a-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:{_EXP})?[jJ]?|{_DIGITS}(?:{_EXP}[jJ]?|[jJ])|(?:[1-9](?:_?[0-9])*+|0(?:_?0)*+)(?!\.)"
_PY = re.compile(
    r"[ \t\f]*+("
    r"(?![rRbBuUfFtT]{1,2}[\"'])[^\W\d]\w*+"
    r"|(?:\r\n?|\n)(?:[ \t\f]*+(?:#[^\r\n]*+)?(?:\r\n?|\n))*+[ \t\f]*+"
    rf"|(?:{_NUMBER})(?:(?!\w)|(?=(?:and|else|for|if|in|is|not|or)\b))"
    r"|\.\.\.|\*\*=|//=|>>=|<<=|:=|->|[+\-*/%&|^@=!<>]=|\*\*|//|<<|>>|[-+*/%&|^~<>@=,:;()\[\]{}.]"
    rf"|(?:[fFtT][rR]?|[rR][fFtT])(?:{_FORMATTED}|{_TRIPLE})"
    rf"|(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?(?:{_TRIPLE}|{_SINGLE})"
    r"|#[^\r\n]*+|\\(?:\r\n?|\n)|[0-9][\w.]*+|[^ \t\f])"
)
_NUMBERS = re.compile(_NUMBER)
_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^{}\n]+\})|[\s\S])")

#: Letter and grammar class of every token kind; keywords stand for themselves in the grammar.
_KEYWORDS = dict(zip(
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split(),
    "aASYWBCKDXIETFfrGiMqQLNoOPRUtwhH", strict=True,
))
_OPERATORS = {
    "(": "PL", ")": "PR", "[": "BL", "]": "BR", "{": "CL", "}": "CR", ",": ",", ":": ":", ";": ";", ".": ".", "=": "=", "@": "@", "*": "*",
    "p": "**", "+": "UN", "~": "UN", "/": "BIN", "%": "BIN", "<": "BIN", "v": ":=", ">": "ARROW", "u": "AUG", "e": "ELL",
}
_CLASS = {"\n": "NL", "0": "END", "n": "NAME", "m": "NAME", "k": "NAME", "y": "NAME", "s": "STR", "g": "STR", "b": "BYTES", "d": "NUM", "c": "CONST", "?": "BAD", "!": "ESC", "#": "", "\\": "", **_OPERATORS, **{v: k for k, v in _KEYWORDS.items()}}
#: Classes no token has by itself.
_EXTRA = {1: "START", 2: "INDENT", 3: "DEDENT", 4: "CNL", 5: "DNAME", 6: "MATCH", 7: "CASE", 8: "TYPE"}
CLASS_NAMES = [_EXTRA.get(i) or _CLASS.get(chr(i), "") for i in range(128)]
_START, _INDENT, _DEDENT, _CNL, _DNAME, _MATCH, _CASE, _TYPE = range(1, 9)
_NL, _END, _NAME = ord("\n"), ord("0"), ord("n")
_SOFT = {ord("m"): _MATCH, ord("k"): _CASE, ord("y"): _TYPE}
_STEP = np.zeros(128, dtype=np.int64)
_STEP[[ord(c) for c in "([{"]] = 1
_STEP[[ord(c) for c in ")]}"]] = -1
_PARTNER = np.zeros(128, dtype=np.int64)
for _a, _b in ("()", "[]", "{}"):
    _PARTNER[ord(_a)] = ord(_b)
_NAMED = np.arange(128)  # letters with one grammar class count as one
for _c, _d in (("g", "s"), ("m", "n"), ("k", "n"), ("y", "n"), ("~", "+"), ("/", "%"), ("<", "%")):
    _NAMED[ord(_c)] = ord(_d)

_FIXED_WORDS = {
    **_KEYWORDS, "None": "c", "True": "c", "False": "c", "match": "m", "case": "k", "type": "y", "...": "e", "->": ">", ":=": "v", "**": "p", "-": "+",
    **{o: o for o in "()[]{},:;.=@*+~/%<"}, ">": "<", **{o: "%" for o in ("//", "&", "|", "^", "<<", ">>")}, **{o: "<" for o in ("<=", ">=", "==", "!=")},
    **{o: "u" for o in ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")}, "\0": "0",
}


def _newlines(s: str) -> int:
    return s.count("\n") + s.count("\r") - s.count("\r\n")


class _Words(dict):
    """Token to letter | newlines << 8 | column << 32 | column with tabs of one << 48."""

    def __missing__(self, s: str) -> int:
        if len(self) > 400_000:
            self.clear()
            self.update((w, ord(c)) for w, c in _FIXED_WORDS.items())
        c, last = s[0], s[-1]
        if c in "\r\n":
            tail = s[max(s.rfind("\n"), s.rfind("\r")) + 1 :].rpartition("\f")[2]
            v = _NL | _newlines(s) << 8 | min(len(tail.expandtabs(8)), 0xFFFF) << 32 | min(len(tail), 0x7FFF) << 48
        elif len(s) > 1 and last in "\"'":
            prefix = s[: min(s.find("'") % (len(s) + 1), s.find('"') % (len(s) + 1))].lower()
            if "b" in prefix:
                letter = "b" if s.isascii() else "?"
            else:
                letter = "g" if "f" in prefix or "t" in prefix else "s"
            if "r" not in prefix and "\\" in s and letter != "?":
                if any(len(m.group()) == 2 and m.group()[1] in ("x" if letter == "b" else "xuUN") for m in _ESCAPE.finditer(s) if not _valid_escape(s, m)):
                    letter = "!"
            v = ord(letter) | _newlines(s) << 8
        elif c == "#":
            v = ord("#")
        elif c == "\\" and len(s) > 1:
            v = ord("\\") | 1 << 8
        elif c.isalpha() or c == "_" or c > "\x7f" and s.isidentifier():
            v = _NAME
        elif c.isdigit() and c.isascii() or c == "." and len(s) > 1:
            v = ord("d" if _NUMBERS.fullmatch(s) else "?")
        else:
            v = ord("?")
        self[s] = v
        return v


def _valid_escape(s: str, m: re.Match) -> bool:
    """Whether the escape at m has the digits or name it needs."""
    kind, rest = m.group()[1:2], s[m.end() : m.end() + 9]
    if kind == "x":
        return bool(re.match(r"[0-9a-fA-F]{2}", rest))
    if kind == "u":
        return bool(re.match(r"[0-9a-fA-F]{4}", rest))
    if kind == "U":
        return bool(re.match(r"00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4}", rest))
    if kind == "N":
        return rest[:1] == "{"
    return True


_WORDS = _Words((w, ord(c)) for w, c in _FIXED_WORDS.items())

# ---------------------------------------------------------------- productions

#: Roles of what brackets hold: expression, target, arguments, parameters, imports, with items, pattern, subscript, type parameters.
_ROLES = {"(": "ETAFIWK", "[": "ETSGK", "{": "EK"}
_BASE = {"(": 0xE000, "[": 0xE100, "{": 0xE200}
_BROKEN = "\uf000"


def _group(kind: str, role: str) -> str:
    """Characters of the groups of a kind of bracket that can play the role."""
    roles = _ROLES[kind]
    return "".join(chr(_BASE[kind] + bits) for bits in range(1 << len(roles)) if bits >> roles.index(role) & 1)


_CALLS, _SUBSCRIPTS = _group("(", "A"), _group("[", "S")
_VALUES = _group("(", "E") + _group("[", "E") + _group("{", "E")
_TARGETS = frozenset(_group("(", "T") + _group("[", "T"))
_PATTERNS = "".join(set(_group("(", "K") + _group("[", "K") + _group("{", "K")) - set(_VALUES))
_ENDS_TARGET = frozenset("n" + _SUBSCRIPTS)

# Steps of a flat window.  Operands become n (a name), J (another target) or V (a value), from tight to loose operators.
_PRIMARY = re.compile(f"W?(?:[ndce{_VALUES}]|[sg]++|b++)(?:\\.n|[{_CALLS}{_SUBSCRIPTS}])*+")
_PATTERN_GROUP = re.compile(f"[{_PATTERNS}]")
_ARITHMETIC = re.compile(r"[+~]++[nJV](?:[%+*p@/][+~]*+[nJV])*+|[nJV](?:[%+*p@/][+~]*+[nJV])++")
_LOOP_HEAD = re.compile(r"f\*?[nJ](?:,\*?[nJ])*+,?q")
_COMPARISON = re.compile(r"[nJV](?:(?:<|oq|q|Qo?+)[nJV])++")
_NEGATION = re.compile(r"o++[nJV]")
_BOOLEAN = re.compile(r"[nJV](?:[aO][nJV])++")
_LOOP = re.compile(r"Z[nJV](?:i[nJV])*+")
_CHOICE = re.compile(r"l++[nJV](?:i[nJV]El*+[nJV])*+|[nJV](?:i[nJV]El*+[nJV])++")

_NAMED_RULE = r"(?:nv)?[nJV]"
_EXPRS = r"\*?[nJV](?:,\*?[nJV])*+,?"
_ITEMS = rf"(?:\*[nJV]|{_NAMED_RULE})(?:,(?:\*[nJV]|{_NAMED_RULE}))*+"
_PRODUCED = rf"(?:H(?:r[nJV]|{_EXPRS})?|{_EXPRS})"
_LOOPED = rf"{_NAMED_RULE}(?:Y?z)++"
_ASSIGNED = r"\*?[nJ](?:,\*?[nJ])*+,?"
_WITHS = r"[nJV](?:A[nJ])?(?:,[nJV](?:A[nJ])?)*+"
_PATTERN = r"(?:n=)?\*?[nJVj](?:An)?"
_PATTERN_LIST = rf"{_PATTERN}(?:,{_PATTERN})*+,?"
_SLICE = rf"(?:\*[nJV]|[nJV]?:[nJV]?(?::[nJV]?)?|{_NAMED_RULE})"
_ENTRY = r"(?:[nJV]:[nJV]|p[nJV])"
_TYPE_PARAMETER = r"(?:n(?::[nJV])?(?:=[nJV])?|\*n(?:=\*?[nJV])?|pn(?:=[nJV])?)"
_SIMPLE = (
    rf"(?:{_EXPRS}|(?:{_ASSIGNED}=)++{_PRODUCED}|[nJ]u{_PRODUCED}|[nJ]:[nJV](?:={_PRODUCED})?|[PBK$]|U(?:{_EXPRS})?|X[nJ](?:,[nJ])*+,?|R(?:[nJV](?:r[nJV])?)?"
    rf"|[GN]n(?:,n)*+|{_PRODUCED}|S[nJV](?:,[nJV])?|\$=[nJV])"
)
_HEADER = (
    rf"(?:[iwI]{_NAMED_RULE}:|[EtF]:|T(?:\*?[nJV](?:An)?|\*?[nJV](?:,[nJV])++)?:|Y?Z{_EXPRS}:|Y?h(?:{_WITHS}|[{_group('(', 'W')}]):|D(?:>{_EXPRS})?:|C:|m{_ITEMS},?:|k{_PATTERN_LIST}(?:i{_NAMED_RULE})?:)"
)
_DOTTED = r"n(?:\.n)*+"
#: Statements with names in places of their own; they become a letter before operands are reduced.
_IMPORT = re.compile(rf"(?:(?<=[:;])|^)(?:M{_DOTTED}(?:An)?(?:,{_DOTTED}(?:An)?)*+|r(?:[.e]++(?:{_DOTTED})?|{_DOTTED})M(?:\*|n(?:An)?(?:,n(?:An)?)*+|[{_group('(', 'I')}]))(?=;|$)")
_ALIAS = re.compile(rf"(?:(?<=[:;])|^)yn[{_group('[', 'G')}]?(?==)")
_DEFINITION = re.compile(rf"^(?:Y?h[{_group('(', 'W')}]|Y?(D)n[{_group('[', 'G')}]?[{_group('(', 'F')}]|Cn[{_group('[', 'G')}]?[{_CALLS}]?)(?=[:>])")

_RULES = {name: re.compile(rule) for name, rule in {
    "line": f"@{_NAMED_RULE}|{_HEADER}|{_HEADER}?{_SIMPLE}(?:;{_SIMPLE})*;?",
    "field": f"{_PRODUCED}|{_LOOPED}",
    "(E": f"|{_NAMED_RULE}|H(?:r[nJV]|{_EXPRS})?|{_ITEMS},|{_ITEMS}(?<!^\\*.)|{_LOOPED}", "(T": f"|{_ASSIGNED}", "(I": r"n(?:An)?(?:,n(?:An)?)*+,?", "(W": f"(?=.*A){_WITHS},?", "(K": f"|{_PATTERN_LIST}",
    "genexp": _LOOPED, "plain": _NAMED_RULE, "keyword": "n=[nJV]", "starred": r"\*[nJV]", "double": "p[nJV]",
    "param": "n(?::[nJV])?", "default": "n(?::[nJV])?=[nJV]", "rest": r"\*n(?::\*?[nJV])?", "others": "pn(?::[nJV])?",
    "[E": f"|{_ITEMS},?|{_LOOPED}", "[T": f"|{_ASSIGNED}", "[S": f"{_SLICE}(?:,{_SLICE})*+,?", "[G": f"{_TYPE_PARAMETER}(?:,{_TYPE_PARAMETER})*+,?", "[K": f"|{_PATTERN_LIST}",
    "{E": f"|{_ITEMS},?|{_LOOPED}|{_ENTRY}(?:,{_ENTRY})*+,?|[nJV]:[nJV](?:Y?z)++", "{K": f"|(?:[nJV]:{_PATTERN}|pn)(?:,(?:[nJV]:{_PATTERN}|pn))*+,?",
}.items()}
_ARGUMENTS = re.compile(r"[ps]*[ks]*[kd]*")
_PARAMETERS = re.compile(r"(?:x*y*|x+/x*y*|x*y+/y*)(?:s[xy]*|b[xy]+)?k?")


def _kinds(window: str, rules: tuple[tuple[str, str], ...]) -> str | None:
    """A letter per comma-separated part of the window; None if a part matches no rule."""
    out = []
    parts = window.split(",")
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    for part in parts:
        for letter, rule in rules:
            if part == rule if len(rule) == 1 else _RULES[rule].fullmatch(part):
                out.append(letter)
                break
        else:
            return None
    return "".join(out)


def _arguments(window: str) -> bool:
    if not window or _RULES["genexp"].fullmatch(window):
        return True
    kinds = _kinds(window, (("k", "keyword"), ("p", "plain"), ("s", "starred"), ("d", "double")))
    return kinds is not None and _ARGUMENTS.fullmatch(kinds) is not None


def _parameters(window: str) -> bool:
    if not window:
        return True
    kinds = _kinds(window, (("x", "param"), ("y", "default"), ("/", "/"), ("b", "*"), ("s", "rest"), ("k", "others")))
    return kinds is not None and _PARAMETERS.fullmatch(kinds) is not None


#: Fixed value: brackets inside one another that Python takes.
MOST_DEPTH = 200
_LAMBDA = re.compile(r"L([^:L]*):")
_INNER = re.compile(r"([(\[{])([^()\[\]{}]*)[)\]}]")
_SOFT_NAMES = str.maketrans("mky", "nnn")


def _operand(m: re.Match) -> str:
    s = m.group()
    if len(s) == 1:
        return "n" if s == "n" else "J" if s in _TARGETS else "V"
    return "J" if s[-1] in _ENDS_TARGET and s[0] != "W" else "V"


def _flat(window: str, looped: bool = True) -> str:
    """A window without brackets, with its operands and operators reduced."""
    window = _operands(window)
    while "L" in window:  # a lambda's head, the innermost first, is a prefix
        shorter = _LAMBDA.sub(lambda m: "l" if _parameters(_loose(m.group(1))) else _BROKEN, window)
        if shorter == window:
            break
        window = shorter
    return _loose(window, looped)


def _operands(window: str) -> str:
    return _ARITHMETIC.sub("V", _PATTERN_GROUP.sub("j", _PRIMARY.sub(_operand, window)))


def _loose(window: str, looped: bool = True) -> str:
    window = _COMPARISON.sub("V", _LOOP_HEAD.sub("Z", window))
    window = _BOOLEAN.sub("V", _NEGATION.sub("V", window))
    return _CHOICE.sub("V", _LOOP.sub("z", window) if looped else window)


@lru_cache(maxsize=100_000)
def _roles(kind: str, window: str) -> str:
    """The letter of a group: its bracket and the roles its window can play."""
    window = window.translate(_SOFT_NAMES)
    plain, bits = _flat(window), 0
    for n, role in enumerate(_ROLES[kind]):
        ok = _arguments(plain) if role == "A" else _parameters(plain) if role == "F" else _RULES[kind + role].fullmatch(window if role == "I" else plain) is not None
        bits |= ok << n
    return chr(_BASE[kind] + bits) if bits else _BROKEN


def _inside(line: str) -> str:
    """The line with every pair of brackets reduced to a letter, innermost windows first."""
    for _ in range(MOST_DEPTH):
        shorter = _INNER.sub(lambda m: _roles(m.group(1), m.group(2)), line)
        if shorter == line:
            break
        line = shorter
    return line  # with brackets left in it, it is no statement


def is_statement(line: str) -> bool:
    """Whether a logical line, a letter a token, is a statement or the head of one."""
    line = _ALIAS.sub("$", _inside(line))
    head, names = line[:1], line.translate(_SOFT_NAMES)
    names = _DEFINITION.sub(lambda m: m.group(1) or "C", _IMPORT.sub("$", names))
    if _RULES["line"].fullmatch(_flat(names, False)):
        return True
    return head in ("m", "k") and _RULES["line"].fullmatch(head + _flat(names[1:], False)) is not None


_LINES: dict[bytes, bool] = {}


def _holds(line: bytes) -> bool:
    known = _LINES.get(line)
    if known is None:
        if len(_LINES) > 300_000:
            _LINES.clear()
        known = _LINES[line] = is_statement(line.decode())
    return known


def _letters(text: str) -> str:
    """Letters of an expression's text; it may go over lines."""
    return "".join(chr(v & 0x7F) for v in map(_WORDS.__getitem__, _PY.findall(text)) if (v & 0x7F) not in (_NL, 35, 92))


@lru_cache(maxsize=50_000)
def fields_hold(token: str) -> bool:
    """Whether the fields of a formatted string hold expressions; braces outside fields are doubled."""
    quote = token[-3:] if token[-3:] in ('"""', "'''") and len(token) > 5 else token[-1]
    begin = token.index(quote) + len(quote)
    body = token[begin : -len(quote)]
    if "{" not in body and "}" not in body:
        return True
    return _fields(body, "r" in token[: begin - len(quote)].lower(), 0)


def _fields(body: str, raw: bool, depth: int) -> bool:
    at = 0
    while at < len(body):
        c = body[at]
        if c == "\\" and not raw:
            named = re.compile(r"\\N\{[^{}]*\}").match(body, at)
            at = named.end() if named else at + (1 if body[at + 1 : at + 2] in "{}" else 2)
        elif c == "{" and body[at + 1 : at + 2] == "{" and not depth:
            at += 2
        elif c == "}":
            if body[at + 1 : at + 2] != "}" or depth:
                return False
            at += 2
        elif c == "{":
            end = _field_end(body, at + 1)
            if end is None:
                return False
            mark, close = end
            text = body[at + 1 : mark].rstrip()
            if text.endswith("=") and text[-2:-1] not in ("=", "!", "<", ">", ":"):
                text = text[:-1]
            if not _RULES["field"].fullmatch(_flat(_inside(_letters(text)).translate(_SOFT_NAMES))):
                return False
            rest = body[mark:close]
            if rest[:1] == "!":
                m = re.compile(r"![^\W\d]\w*\s*").match(rest)
                if not m or m.end() < len(rest) and rest[m.end()] != ":":
                    return False
                rest = rest[m.end() :]
            if rest[:1] == ":" and ("{" in rest or "}" in rest) and (depth > 8 or not _fields(rest[1:], raw, depth + 1)):
                return False
            at = close + 1
        else:
            at += 1
    return True


_FIELD_PART = re.compile(r"[rRbBuU]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\n]*\"|'[^'\n]*')|[()\[\]{}:]|!=|!|[^()\[\]{}:!\"']+|.")


def _field_end(body: str, at: int) -> tuple[int, int] | None:
    """(place of the field's ! or : or end, place of its closing brace)."""
    level, mark, lambdas = 0, None, 0
    for m in _FIELD_PART.finditer(body, at):
        s = m.group()
        if s in ("(", "[", "{"):
            level += 1
        elif s in (")", "]"):
            level -= 1
        elif s == "}":
            if level == 0:
                return (m.start() if mark is None else mark), m.start()
            level -= 1
        elif s in (":", "!") and level == 0 and mark is None:
            if s == ":" and lambdas:
                return None  # a lambda has to stand in brackets
            mark = m.start()
        elif level == 0 and mark is None and re.search(r"\blambda\b", s):
            lambdas += 1
    return None


# ---------------------------------------------------------------- lines

_CLAUSE = {_KEYWORDS[w]: w for w in ("if", "elif", "else", "for", "while", "try", "except", "finally")}
_CLAUSE_OF = [_CLAUSE.get(chr(i), "other") for i in range(128)]
_ASYNC, _AT = ord("Y"), ord("@")
_DECORATED = frozenset(map(ord, "@DC"))


def lex_python(texts: list[str]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], list[tuple[int, int, int, str, int]], list[tuple[int, str, int]]]:
    """Rows of a batch of files, each with the file's number first.

    pairs (file, letter, letter, line): the distinct adjacent tokens of a file and where
    they come first.  brackets (file, letter, line): those that do not close on their
    line.  chains (file, chain, place, clause head, line) and faults (file, what, line).
    """
    tokens: list[str] = []
    counts = []
    for t in texts:
        found = _PY.findall("\n" + (t[1:] if t[:1] == "\ufeff" else t))
        found += ["\n", "\0"]
        counts.append(len(found))
        tokens += found
    v = np.fromiter(map(_WORDS.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    code, lines = v & 0x7F, v >> 8 & 0xFFFFFF
    file = np.repeat(np.arange(len(texts)), counts)
    begin = np.cumsum(counts) - counts
    line = np.cumsum(lines) - lines
    line -= np.repeat(line[begin], counts)
    faults = [(int(file[k]), "character or unfinished literal", int(line[k])) for k in np.flatnonzero((code == ord("?")) | (code == ord("!")))]
    faults += [(int(file[k]), "field of a formatted string", int(line[k])) for k in np.flatnonzero(code == ord("g")) if not fields_hold(tokens[k])]
    keep = (code != ord("#")) & (code != ord("\\"))
    v, code, file, line = v[keep], code[keep], file[keep], line[keep]
    step = _STEP[code]
    depth = np.cumsum(step)
    first = np.flatnonzero(np.r_[True, file[1:] != file[:-1]])
    depth -= np.repeat((depth - step)[first], np.diff(np.r_[first, len(file)]))

    bracket = np.flatnonzero(step)
    level = depth[bracket] + (step[bracket] < 0)
    order = np.lexsort((bracket, level, file[bracket]))
    by = bracket[order]
    close = np.flatnonzero((file[by][1:] == file[by][:-1]) & (level[order][1:] == level[order][:-1]) & (_PARTNER[code[by][:-1]] == code[by][1:]) & (line[by][1:] == line[by][:-1]))
    open_ = np.ones(len(by), dtype=bool)
    open_[close] = open_[close + 1] = False
    left = np.sort(by[open_])
    brackets = (file[left], code[left], line[left])

    newline = code == _NL
    keep = ~newline | (depth <= 0)
    v, code, file, line, newline = v[keep], code[keep], file[keep], line[keep], newline[keep]
    again = newline & np.r_[newline[1:] & (file[1:] == file[:-1]), False]
    v, code, file, line = v[~again], code[~again], file[~again], line[~again]

    ends = np.flatnonzero(code == _NL)
    statements = code.astype(np.uint8).tobytes().split(b"\n")[1:]
    for k, s in enumerate(statements):
        if not _LINES.get(s) and s != b"0" and not _holds(s):
            at = ends[k] + 1
            faults.append((int(file[at]), "statement", int(line[at])))

    chains, events = _indentation(ends, v, code, file, line, faults)
    # Letters as the grammar's classes see them.
    seen = _NAMED[code]
    after = np.r_[False, (code[:-1] == ord("D")) | (code[:-1] == ord("C"))]
    seen[after & (seen == _NAME)] = _DNAME
    for k in np.flatnonzero(np.isin(code[ends[:-1] + 1], list(_SOFT))) if len(ends) > 1 else ():
        s, at = statements[k], ends[k] + 1
        if s[:1] == b"y":
            soft = s[1:2] in (b"n", b"m", b"k", b"y") and s[2:3] in (b"=", b"[")
        else:
            soft = s[1:2] not in (b"=", b".", b",", b":", b";", b"u", b"v", b"", b"%", b"/", b"<", b"a", b"O", b"q", b"Q", b"i") and (s[-1:] == b":" if s[:1] == b"m" else b":" in s)
        if soft:
            seen[at] = _SOFT[int(code[at])]
    colon = ends[(ends > 0)]
    colon = colon[code[colon - 1] == ord(":")]
    seen[colon - 1] = _CNL
    first = np.flatnonzero(np.r_[True, file[1:] != file[:-1]])
    seen[first] = _START
    drop = np.zeros(len(seen), dtype=bool)
    drop[colon] = True
    drop[first] = False
    if events:
        places, kinds = np.array([p for p, _ in events]) + 1, np.array([c for _, c in events])
        seen, file, line, drop = np.insert(seen, places, kinds), np.insert(file, places, file[places]), np.insert(line, places, line[places]), np.insert(drop, places, False)
    seen, file, line = seen[~drop], file[~drop], line[~drop]
    same = file[1:] == file[:-1]
    key = ((file[:-1] << 14) | (seen[:-1] << 7) | seen[1:])[same]
    key, at = np.unique(key, return_index=True)
    pairs = (key >> 14, key >> 7 & 0x7F, key & 0x7F, line[1:][same][at])
    return pairs, brackets, chains, faults


def _indentation(ends: np.ndarray, v: np.ndarray, code: np.ndarray, file: np.ndarray, line: np.ndarray, faults: list) -> tuple[list, list[tuple[int, int]]]:
    """(chains, (place, INDENT or DEDENT) events) of the lines behind the newlines at ends."""
    heads = code[ends + 1]
    deeper = np.flatnonzero(heads == _ASYNC)
    heads[deeper] = code[ends[deeper] + 2]
    chains: list[tuple[int, int, int, str, int]] = []
    events: list[tuple[int, int]] = []
    n_chain, stack, opened, now, decorated = 0, [(0, 0)], {0: None}, -1, None

    def finish() -> None:
        for c in opened.values():
            if c is not None and c[1][-1][0] == "try":
                c[1].append(("other", c[1][-1][1]))

    done: list = []
    for at, f, width, alt, head, ln in zip(ends.tolist(), file[ends].tolist(), (v[ends] >> 32 & 0xFFFF).tolist(), (v[ends] >> 48 & 0x7FFF).tolist(), heads.tolist(), line[ends + 1].tolist(), strict=True):
        if f != now:
            finish()
            stack, opened, now, decorated = [(0, 0)], {0: None}, f, None
        if decorated is not None and (head not in _DECORATED or width != decorated):
            faults.append((f, "statement", ln))
        decorated = width if head == _AT else None
        if head == _END:
            events += [(at, _DEDENT)] * (len(stack) - 1)
            continue
        top, top_alt = stack[-1]
        if width != top or alt != top_alt:
            if width > top:
                if alt <= top_alt:
                    faults.append((f, "tabs and spaces", ln))
                stack.append((width, alt))
                opened[width] = None
                events.append((at, _INDENT))
            else:
                while width < stack[-1][0]:
                    gone = opened.pop(stack.pop()[0], None)
                    if gone is not None and gone[1][-1][0] == "try":
                        gone[1].append(("other", ln))
                    events.append((at, _DEDENT))
                if width != stack[-1][0]:
                    faults.append((f, "dedent to no outer level", ln))
                    stack.append((width, alt))
                    opened[width] = None
                elif alt != stack[-1][1]:
                    faults.append((f, "tabs and spaces", ln))
        word = _CLAUSE_OF[head]
        chain = opened[width]
        if word in ("elif", "else", "except", "finally"):
            if chain is None:
                chain = opened[width] = (f, [("none", ln)])
                done.append(chain)
            chain[1].append((word, ln))
        else:
            if chain is not None and chain[1][-1][0] == "try":
                chain[1].append(("other", ln))
            opened[width] = None
            if word != "other":
                opened[width] = (f, [(word, ln)])
                done.append(opened[width])
    finish()
    for f, heads_ in done:
        if len(heads_) > 1:
            chains += [(f, n_chain, i, head, ln) for i, (head, ln) in enumerate(heads_)]
            n_chain += 1
    return chains, events
