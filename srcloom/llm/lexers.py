"""Lexers that turn JSON and script text into token classes of srcloom.llm.grammar.

Each returns (sequences, chains, faults): sequences of (class, line), the clause chains
of statements as lists of (head, line), and lexical faults as (what, line).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import repeat

Sequences = list[list[tuple[str, int]]]

_JSON = re.compile(r"(?P<space>[ \t]+)|(?P<nl>\r?\n|\r)|(?P<str>\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*\")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<const>(?:true|false|null)\b)|(?P<op>[{}\[\],:])")


def lex_json(text: str, suffix: str = "json") -> tuple[Sequences, list, list]:
    out, faults, stack, line, at = [("START", 1)], [], [], 1, 0
    while at < len(text):
        m = _JSON.match(text, at)
        if not m:
            faults.append(("character or literal", line))
            break
        kind, s = m.lastgroup, m.group()
        at = m.end()
        if kind == "nl":
            line += 1
        elif kind == "str":
            out.append(("KEY" if stack[-1:] == ["{"] and out[-1][0] in ("OL", ",") else "STR", line))
        elif kind == "num":
            out.append(("NUM", line))
        elif kind == "const":
            out.append(("CONST", line))
        elif kind == "op":
            if s in "{[":
                stack.append(s)
            elif s in "}]" and stack:
                stack.pop()
            c = {"{": "OL", "}": "OR", "[": "BL", "]": "BR"}.get(s, s)
            out.append((c, line))
    out.append(("END", line))
    # In an object a comma is followed by a key, in a list by a value.
    stack = []
    for (a, _), (b, ln) in zip(out, out[1:], strict=False):
        if a in ("OL", "BL"):
            stack.append(a)
        elif a in ("OR", "BR") and stack:
            stack.pop()
        if a == "," and (not stack or (stack[-1] == "OL") != (b == "KEY")) or a in ("STR", "NUM", "CONST", "OR", "BR") and not stack and b not in ("END",) or a == "KEY" and b != ":":
            faults.append(("place of a value", ln))
    return [out], [], faults


_NAME = re.compile(r"[A-Za-z_$][\w$]*+|#?[^\W\d][\w$]*+")
_MARKS = frozenset("(){}[];:?=.,+-*/%&|^~<>!@\"'`0123456789")
_JS_NUM = re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])")
_JS_STR = re.compile(r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'")
_JS_RE = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*(?![\w$])")
_JS_OP = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.(){}\[\]@]")
_GAP = re.compile(r"(?:[ \t\f\v\xa0\ufeff]++|//[^\n]*+|/\*[\s\S]*?\*/|\r?\n|[\r\u2028])*+")
_LINE_END = re.compile(r"[\n\r\u2028]")
_DECORATOR = re.compile(r"@\s*[\w$]+(?:\s*\.\s*[\w$]+)*")
_JS_KEYWORDS = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return switch throw try typeof var void while with yield await".split())
#: Words that can be more than a name.
_SPECIAL = _JS_KEYWORDS | frozenset("null true false of from as satisfies async get set static type public private protected readonly override abstract declare accessor interface enum namespace module implements".split())
_OPERAND = frozenset("NAME CONST NUM STR TPL RE JSX PR BR OR BANG INC TYPE GEN".split())
_BINARY = frozenset("* / % ** < > <= >= == != === !== && || ?? & | ^ << >> >>> instanceof".split())
_ASSIGN = frozenset("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_ATOM = (
    rf"(?!(?:{'|'.join(sorted(_SPECIAL))})(?![\w$]))[A-Za-z_$][\w$]*+|\"(?:[^\"\\\n]|\\[^\n])*+\"|'(?:[^'\\\n]|\\[^\n])*+'|(?:0|[1-9][0-9]*+)(?![\w.$])"
    r"|>>>=|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>>|\*\*|[%&|^>~=,]|\.[ \t]*+(?:[A-Za-z_$][\w$]*+)?(?!\d)|[+](?!\+)|-(?!-)"
)
_INNER = rf"(?:[ \t]|{_ATOM}|\((?:[ \t]|{_ATOM})*+\)|\[(?:[ \t]|{_ATOM})*+\])*+"
#: Runs of tokens on one line whose classes do not depend on what stands around the run.
_RUN = re.compile(rf"(?:[ \t]*+(?:{_ATOM}|\({_INNER}\)|\[{_INNER}\]))++")
_IN_RUN = re.compile(_ATOM.replace("[ \\t]*+(?:[A-Za-z_$][\\w$]*+)?", "") .split("(?![\\w$]))", 1)[1] + r"|[()\[\]]")
#: Behind these a statement starts, or a word is no plain name.
_STARTING = frozenset("START NL ; GL GR LAB else do export declare default".split())


class _Plain(dict):
    """Class of a token of a run."""

    def __missing__(self, s: str) -> str:
        if len(self) > 200_000:
            self.clear()
            self.update(_PLAIN_CLASSES)
        c = s[0]
        self[s] = got = "STR" if c in "\"'" else "NUM" if c.isdigit() else "NAME" if c.isalpha() or c in "_$" else s
        return got


_PLAIN_CLASSES = {"~": "UN", "+": "UN2", "-": "UN2", "(": "PL", ")": "PR", "[": "BL", "]": "BR", **{o: "BIN" for o in _BINARY}, **{o: "ASG" for o in _ASSIGN}}
_plain = _Plain(_PLAIN_CLASSES).__getitem__
_TYPE_BALANCED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*[\s\S]*?\*/|=>|[()\[\]{}<>]")
_PAIRED = {")": "(", "]": "[", "}": "{", ">": "<"}


_LOOK_0 = re.compile(r"(?:keyof|typeof|readonly|unique|infer|asserts|new|abstract)\b(?!\s*[,;)=>|&\]])\s*|[|&]\s*")
_LOOK_1 = re.compile(r"-?\d[\w.]*")
_LOOK_2 = re.compile(r"\s*\.\s*[\w$]+")
_LOOK_3 = re.compile(r"is\b|extends\b")
_LOOK_4 = re.compile(r"<\s*([\w$.:-]*)")
_LOOK_5 = re.compile(r"[\w$:-]+\s*(=\s*)?")
_LOOK_6 = re.compile(r"\"[^\"]*\"|'[^']*'")
_LOOK_7 = re.compile(r"[^<{}>]*")
_LOOK_8 = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>")
_LOOK_9 = re.compile(r"enum\b")
_LOOK_10 = re.compile(r"[\w$]+\s*")
_LOOK_11 = re.compile(r"<[\w$\s,.\[\]|&<>{}:;\"'?=()-]*?>(?=\s*\()")
_LOOK_12 = re.compile(r"\s*\{")
_LOOK_13 = re.compile(r"(?:catch|finally)\b")


_CODE_MARK = re.compile(r"\\.|\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'|/\*[\s\S]*?\*/|\$\{|[{}`]", re.DOTALL)
_TYPE_TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|[\w$#]+|\.\.\.|=>|[^\s]")
#: Words of types that can stand beside another name.
_TYPE_WORDS = frozenset("keyof typeof readonly unique infer asserts new abstract get set is extends in as out const public private protected static async override declare accessor import".split())
_TYPE_ENDS = frozenset("NAME W STR NUM T ) ] } > ? !".split())
_TYPE_STARTS = frozenset("NAME W STR NUM [ ( < + -".split())


_GENERIC_STRETCH = re.compile(r"[\w$\s,.\[\]|&<>{}:;\"'?=()-]*+")


class _Script:
    """One pass over a TypeScript or JavaScript text with the bracket context that tells tokens apart."""

    def __init__(self, text: str, suffix: str):
        self.t, self.ts, self.jsx = text, suffix in ("ts", "tsx"), suffix in ("tsx", "jsx")
        self.sequences: Sequences = []
        self.chains: list[list[tuple[str, int]]] = []
        self.faults: list[tuple[str, int]] = []
        self.ends = [m.start() for m in re.finditer("\n", text)]
        self.todo = [(0, len(text), "START", "END")]  # stretches still to be lexed: expressions inside templates and elements are sequences of their own
        self.declared = False
        self.no_generic = -1  # up to here no type argument list before a call is left

    def line(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1

    def lex(self) -> None:
        while self.todo:
            self.run(*self.todo.pop())

    def gap(self, at: int) -> tuple[int, bool]:
        m = _GAP.match(self.t, at)
        return m.end(), m.end() > at and bool(_LINE_END.search(m.group()))

    def balanced(self, at: int, angle: bool = False) -> int:
        stack = []
        for m in _TYPE_BALANCED.finditer(self.t, at):
            s = m.group()
            if s in ("(", "[", "{") or s == "<" and (angle or stack):
                stack.append(s)
            elif s in _PAIRED:
                if s == ">" and (not stack or stack[-1] != "<"):
                    continue
                while stack and stack[-1] == "<" and s != ">":
                    stack.pop()
                if not stack or stack[-1] != _PAIRED[s]:
                    return -1
                stack.pop()
                if not stack:
                    return m.end()
        return -1

    def type(self, at: int) -> int:
        """Place behind the type expression at at, or -1; conditions inside one another wait on a stack."""
        waits: list[str] = []
        while True:
            at, _ = self.gap(at)
            while m := _LOOK_0.match(self.t, at):
                at = m.end()
            c = self.t[at : at + 1]
            if c in ("(", "{", "["):
                end = self.balanced(at)
                if end < 0:
                    return -1
                at = end
                nxt, _ = self.gap(at)
                if c == "(" and self.t.startswith("=>", nxt):
                    at = nxt + 2
                    continue
            elif c == "<":
                end = self.balanced(at, True)
                if end < 0:
                    return -1
                at = end
                continue
            elif m := _JS_STR.match(self.t, at) or _LOOK_1.match(self.t, at):
                at = m.end()
            elif c == "`":
                at = self.t.find("`", at + 1) + 1
                if not at:
                    return -1
            elif m := _NAME.match(self.t, at):
                at = m.end()
                if m.group() == "import" and self.t.startswith("(", self.gap(at)[0]):
                    at = self.balanced(self.gap(at)[0])
                    if at < 0:
                        return -1
                while m := _LOOK_2.match(self.t, at):
                    at = m.end()
            else:
                return -1
            while True:
                if self.t.startswith("[", at) or self.t.startswith("<", at):
                    end = self.balanced(at, True)
                    if end < 0:
                        return -1
                    at = end
                    continue
                break
            nxt, _ = self.gap(at)
            if m := _LOOK_3.match(self.t, nxt):
                waits.append(m.group())
                at = m.end()
                continue
            if self.t[nxt : nxt + 1] in ("|", "&") and self.t[nxt : nxt + 2] not in ("||", "&&"):
                at = nxt
                continue
            # A type ends here, and with it those it is the last part of.
            while waits:
                wait = waits.pop()
                if wait == "extends" and self.t.startswith("?", nxt):
                    waits.append("?")
                    at = nxt + 1
                    break
                if wait == "?":
                    if not self.t.startswith(":", nxt):
                        return -1
                    at = nxt + 1  # the last branch is a type like any other
                    break
            else:
                return at

    def generic(self, at: int) -> re.Match | None:
        """The match of a type argument list before a call; a failed look holds for the whole stretch it went over."""
        if at < self.no_generic:
            return None
        m = _LOOK_11.match(self.t, at)
        if not m:
            self.no_generic = _GENERIC_STRETCH.match(self.t, at + 1).end()
        return m

    def inner(self, a: int, b: int, spread: bool = False) -> None:
        """Lex the expression between a and b as a sequence of its own."""
        if self.gap(a)[0] < b:
            self.todo.append((a, b, "PL", "PR"))

    def template(self, at: int) -> int:
        """Place behind the template at at, or -1; its expressions are to be lexed."""
        k = at + 1
        while k < len(self.t):
            c = self.t[k]
            if c == "\\":
                k += 2
            elif c == "`":
                return k + 1
            elif self.t.startswith("${", k):
                end = self.code_block(k + 1)
                if end < 0:
                    return -1
                if self.gap(k + 2)[0] >= end - 1:
                    return -1
                self.inner(k + 2, end - 1)
                k = end
            else:
                k += 1
        return -1

    def code_block(self, at: int) -> int:
        """Place behind the brace or back tick that closes the one at at, over strings and templates inside, or -1."""
        t, open_ = self.t, []
        for m in _CODE_MARK.finditer(t, at):
            s = m.group()
            if open_ and open_[-1] == "`":
                if s == "${":
                    open_.append("{")
                elif s[0] == "`":
                    open_.pop()
            elif s in ("{", "${", "`"):
                open_.append(s[-1])
            elif s == "}":
                open_.pop()
            elif s[0] == "\"" or s[0] == "'":
                pass  # a string; a quote by itself stands in the text of an element
            if not open_:
                return m.end()
        return -1

    def element(self, at: int) -> int:
        """Place behind the JSX element at at, or -1; elements inside it are kept on a stack of names."""
        t, names, k = self.t, [], at
        while True:
            # An opening tag at k.
            m = _LOOK_4.match(t, k)
            name, k = m.group(1), m.end()
            while name:
                k, _ = self.gap(k)
                if t.startswith("/>", k) or t.startswith(">", k):
                    break
                if t.startswith("{", k):
                    end = self.code_block(k)
                    if end < 0:
                        return -1
                    k = end
                    continue
                a = _LOOK_5.match(t, k)
                if not a:
                    return -1
                k = a.end()
                if a.group(1):
                    if s := _LOOK_6.match(t, k):
                        k = s.end()
                    elif t.startswith("{", k):
                        end = self.code_block(k)
                        if end < 0:
                            return -1
                        self.inner(k + 1, end - 1)
                        k = end
                    else:
                        return -1
            if name and t.startswith("/>", k):
                k += 2
            elif t.startswith(">", k):
                names.append(name)
                k += 1
            else:
                return -1
            # Text, expressions and closing tags up to the next opening tag.
            while names:
                k = _LOOK_7.match(t, k).end()
                c = t[k : k + 1]
                if c == "{":
                    end = self.code_block(k)
                    if end < 0:
                        return -1
                    self.inner(k + 1, end - 1)
                    k = end
                elif c == "<":
                    close = _LOOK_8.match(t, k)
                    if not close:
                        break
                    if close.group(1) != names.pop():
                        return -1
                    k = close.end()
                else:
                    return -1
            if not names:
                return k

    def types(self, a: int, b: int) -> None:
        """Lex the types between a and b as a sequence of its own classes."""
        out, line, at, last = [("t.START", self.line(a))], self.line(a), a, ""
        for m in _TYPE_TOKEN.finditer(self.t, a, b):
            s = m.group()
            skipped = self.t.count("\n", at, m.start())
            line, at = line + skipped, m.start()
            if s.startswith(("//", "/*")):
                continue
            c = s[0]
            kind = "T" if c == "`" else "STR" if c in "\"'" and len(s) > 1 else "NUM" if c.isdigit() else "W" if s in _TYPE_WORDS else "NAME" if c.isalpha() or c in "_$#" else "BAR" if s in "|&" else s
            if (skipped or self.t.count("\n", last_end, m.start()) if last else False) and last in _TYPE_ENDS and kind in _TYPE_STARTS:
                out.append(("t.NL", line))
            out.append(("t." + kind, line))
            last, last_end = kind, m.end()
        out.append(("t.END", line))
        self.sequences.append(out)

    def targets(self, out: list[tuple[str, int]]) -> None:
        """Faults of assignments to calls and of constants without a value, from windows of a lexed sequence."""
        classes = [c for c, _ in out]
        for k in [k for k in range(1, len(classes)) if classes[k] in ("=", "ASG") and classes[k - 1] == "PR"]:
            depth, j = 0, k - 1
            while j >= 0:
                depth += (classes[j] == "PR") - (classes[j] == "PL")
                if depth == 0:
                    break
                j -= 1
            if j > 0 and classes[j - 1] in ("NAME", "PR", "BR"):
                self.faults.append(("assignment target", out[k][1]))
        if not self.declared:
            self.faults += [("constant without a value", out[k][1]) for k in range(len(out) - 2) if classes[k] == "const" and classes[k + 1] == "NAME" and classes[k + 2] in (";", "NL", "GR", "END")]

    def run(self, at: int, end: int, first: str = "START", final: str = "END") -> None:
        t, ts = self.t, self.ts
        out = [(first, self.line(at))]
        self.sequences.append(out)
        line, seen = out[0][1], at
        # Context of open brackets: kind (G C O PL BL), pending ternaries, opener word, statement word.
        stack: list[dict] = [{"kind": "PL" if first == "PL" else "G", "q": 0, "word": "", "stmt": "", "chain": None}]
        pending = ""  # word of the statement or clause whose block or parentheses come next
        class_head = False

        def put(c: str) -> None:
            out.append((c, line))

        run, inside = _RUN.match, _IN_RUN.findall
        while True:
            prev, kind = out[-1][0], stack[-1]["kind"]
            if not pending and (kind in ("PL", "BL", "O") or kind == "G" and prev not in _STARTING) and (m := run(t, at, end)):
                out.extend(zip(map(_plain, inside(t, at, m.end())), repeat(line)))
                at = m.end()
                continue
            c = t[at : at + 1]
            if c == " ":
                at += 1
                c = t[at : at + 1]
            if "!" <= c <= "~" and c != "/":
                new = False
                if at >= end:
                    break
            else:
                at, new = self.gap(at)
                if at >= end:
                    break
                line += t.count("\n", seen, at)
                seen = at
            top = stack[-1]
            c = t[at]
            operand = prev in _OPERAND or prev == "GR" and top["kind"] not in ("G", "C")
            if new and top["kind"] in ("G", "C") and (prev in _OPERAND or prev in ("break", "continue", "return", "debugger", "GR")) and (c.isalnum() or c in "_$\"'`{@!~#[*" or t.startswith("++", at) or t.startswith("--", at)):
                word = m.group() if (m := _NAME.match(t, at)) else ""
                if not (c in "`[*" and top["kind"] == "G") and word not in ("in", "instanceof") and not (word in ("as", "satisfies") and ts) and not (c == "{" and (class_head or prev in ("PR", "TYPE") and pending)) and not (c == "!" and t.startswith("!=", at)):
                    if prev != "GR":
                        if top["stmt"] == "import" and prev in ("NAME", "OR") and word != "from":
                            self.faults.append(("import without a source", line))
                        put("NL")
                        prev, operand = "NL", False
                    top["stmt"] = ""
            starts = prev in ("START", "NL", ";", "GL", "GR", "LAB") or prev == "PR" and pending == "body"
            if starts and top["kind"] in ("G", "C") and prev != "LAB":
                top["stmt"] = ""
            if c not in _MARKS and (m := _NAME.match(t, at)):
                w, after = m.group(), m.end()
                if prev in (".", "?.") or w not in _SPECIAL and (top["kind"] in ("PL", "BL") or top["kind"] == "G" and not starts and prev not in ("else", "do", "export", "GR", "declare", "default")):
                    at = after
                    out.append(("NAME", line))
                    continue
                nxt = after + 1 if t[after : after + 1] == " " and "!" <= t[after + 1 : after + 2] <= "~" and t[after + 1] != "/" else after if "!" <= t[after : after + 1] <= "~" and t[after] != "/" else self.gap(after)[0]
                n1, n2 = t[nxt : nxt + 1], t[nxt : nxt + 2]
                at = after
                if top["kind"] == "O":
                    if w in ("get", "set", "async", "static") and prev in ("OL", ",") and (n1.isalnum() or n1 in "_$[\"'*#"):
                        put("MOD")
                    elif w == "as" and prev in ("NAME", "STR", "default", "CONST") and n1 not in (",", "}", ":"):
                        put("as")
                    elif w == "type" and ts and top["stmt"] in ("import", "export") and (n1.isalpha() or n1 == "_") and not t.startswith("as", nxt):
                        put("TYPEWORD")
                    elif w == "default" and top["stmt"] in ("import", "export"):
                        put("default")
                    elif prev in ("OL", ",", "MOD", "STAR") and (n1 in (":", "(", ",", "}") or n1 == "=" and n2 != "=="):
                        put("NAME")
                    else:
                        self.word(w, put, top, n1, t, nxt, operand)
                    continue
                if top["kind"] == "C" and not operand and prev in ("GL", "GR", ";", "NL", "MOD", "PR", "NAME", "@", "BR", "STAR") and (n1 in ("(", "=", ":", ";", "}", "?", "!", "<") and not (w in ("static",) and n1 == "{")):
                    put("NAME")
                    top["stmt"] = "member"
                    continue
                if top["kind"] == "C" and not operand and w in (("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor") if ts else ("static", "async", "get", "set", "accessor")):
                    put("static" if w == "static" and n1 == "{" else "MOD")
                    continue
                if ts and top["kind"] == "PL" and prev in ("PL", ",", "MOD", "PR") and w in ("public", "private", "protected", "readonly", "override") and (n1.isalpha() or n1 in "_$"):
                    put("MOD")
                    continue
                if ts and operand and w in ("as", "satisfies") and not (top["stmt"] in ("import", "export") and top["kind"] == "G" and prev == "STAR"):
                    e = self.type(after) if not t.startswith("const", nxt) else nxt + 5
                    if e < 0:
                        self.faults.append(("type", line))
                        break
                    at = e
                    if prev == "TYPE":
                        continue
                    put("TYPE")
                    continue
                if ts and starts or ts and prev in ("export", "declare", "default"):
                    if w in ("interface", "enum", "namespace", "module") and (n1.isalpha() or n1 in "_$\"'") or w == "const" and _LOOK_9.match(t, nxt):
                        b = t.find("{", after)
                        e = self.balanced(b) if b > 0 else -1
                        if e < 0:
                            self.faults.append(("declaration", line))
                            break
                        if w in ("interface", "enum", "const"):
                            self.types(b, e)
                        at = e
                        put("TYPE")
                        put(";")
                        continue
                    if w == "type" and (n1.isalpha() or n1 in "_$") and (m2 := _LOOK_10.match(t, nxt)):
                        b = m2.end()
                        if t.startswith("<", b):
                            b = self.balanced(b, True)
                        b, _ = self.gap(b)
                        e = self.type(b + 1) if b > 0 and t.startswith("=", b) else -1
                        if e < 0:
                            self.faults.append(("declaration", line))
                            break
                        self.types(b + 1, e)
                        at = e
                        put("TYPE")
                        continue
                    if w == "declare" and (n1.isalpha()):
                        self.declared = True
                        continue
                    if w == "abstract" and t.startswith("class", nxt):
                        put("abstract")
                        continue
                if class_head and ts and w == "implements":
                    b = t.find("{", after)
                    if b < 0:
                        self.faults.append(("class", line))
                        break
                    self.types(after, b)
                    at = b
                    put("TYPE")
                    continue
                if w == "type" and ts and top["stmt"] in ("import", "export") and prev in ("import", "export") and n1 in "{*_" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" and not t.startswith("from", nxt):
                    put("TYPEWORD")
                    continue
                if starts or top["kind"] == "G" and prev in ("else", "do") or prev == "export":
                    top["stmt"] = w if prev not in ("export",) else "export " + w
                if w in ("if", "while", "for", "switch", "catch", "with"):
                    pending = w
                elif w in ("else", "do", "try", "finally"):
                    pending = w
                if w in ("else", "catch", "finally") and prev == "GR":
                    chain = top["chain"] or [("none", line)]
                    if chain not in self.chains:
                        self.chains.append(chain)
                    chain.append((w, line))
                    top["next"] = chain
                elif w in ("else", "catch", "finally"):
                    if w != "else":
                        self.chains.append([("none", line), (w, line)])
                elif prev == "GR" and top["chain"] and top["chain"][-1][0] == "try":
                    top["chain"].append(("other", line))
                    self.chains.append(top["chain"])
                    top["chain"] = None
                if w == "class":
                    class_head = True
                self.word(w, put, top, n1, t, nxt, operand)
                continue
            if c in "\"'":
                m = _JS_STR.match(t, at)
                if not m:
                    self.faults.append(("unfinished string", line))
                    break
                put("STR")
                at = m.end()
                continue
            if c == "`":
                e = self.template(at)
                if e < 0:
                    self.faults.append(("unfinished template", line))
                    break
                put("TPL")
                at = e
                continue
            if c.isdigit() or c == "." and t[at + 1 : at + 2].isdigit():
                m = _JS_NUM.match(t, at)
                if not m:
                    self.faults.append(("number", line))
                    break
                put("NUM")
                at = m.end()
                continue
            if c == "/" and not operand and (m := _JS_RE.match(t, at)):
                put("RE")
                at = m.end()
                continue
            if c == "<":
                if ts and (m := self.generic(at)) and (prev in ("NAME", "function", "PL", "=", ",", "=>", "return", "MOD", "async", "START") or class_head):
                    e = self.balanced(at, True)
                    if e > 0 and t[self.gap(e)[0] : self.gap(e)[0] + 1] == "(":
                        put("GEN")
                        at = e
                        continue
                if class_head and ts:
                    e = self.balanced(at, True)
                    if e > 0:
                        put("GEN")
                        at = e
                        continue
                if not operand:
                    e = self.element(at) if self.jsx else -1
                    if e < 0:
                        self.faults.append(("element" if self.jsx else "operand <", line))
                        break
                    put("JSX")
                    at = e
                    continue
            if c == "@" and (m := _DECORATOR.match(t, at)):
                put("@")
                at = m.end()
                continue
            m = _JS_OP.match(t, at)
            if not m:
                if at == 0 and t.startswith("#!"):
                    at = t.find("\n") if "\n" in t else end
                    continue
                self.faults.append(("character", line))
                break
            s = m.group()
            at = m.end()
            if s in ("(", "["):
                put("PL" if s == "(" else "BL")
                is_for = pending == "for" and s == "("
                stack.append({"kind": "PL" if s == "(" else "BL", "q": 0, "word": pending if s == "(" else "", "stmt": "", "chain": None, "for": is_for})
                if s == "(":
                    pending = ""
            elif s in (")", "]"):
                put("PR" if s == ")" else "BR")
                if len(stack) > 1:
                    gone = stack.pop()
                    if s == ")" and gone["word"] in ("if", "while", "for", "switch", "catch", "with"):
                        pending = gone["word"]
                        if gone["word"] in ("if", "while", "for", "with") and not _LOOK_12.match(t, at):
                            pending = "body"
            elif s == "{":
                if pending == "body":
                    pending = ""
                block = prev in ("=>", "PR", "else", "try", "finally", "do", "static", "GL", "GR", ";", "NL", "START", "LAB", "catch") or class_head or prev == "TYPE" and top["kind"] in ("G", "C") or prev == "TYPE" and top["kind"] == "O" or prev == "NAME" and top["kind"] == "C"
                if prev == "TYPE" and top["kind"] in ("PL", "BL"):
                    block = True
                if top["kind"] == "O" and prev in ("OL", ","):
                    block = False
                if block:
                    put("GL")
                    word = "class" if class_head else pending if pending in ("if", "else", "try", "catch", "finally", "for", "while", "do", "switch") else ""
                    stack.append({"kind": "C" if class_head else "G", "q": 0, "word": word, "stmt": "", "chain": None, "link": top.pop("next", None)})
                    class_head = False
                    pending = ""
                else:
                    put("OL")
                    stack.append({"kind": "O", "q": 0, "word": "", "stmt": top["stmt"].split(" ")[0], "chain": None})
            elif s == "}":
                gone = stack.pop() if len(stack) > 1 else None
                put("OR" if gone and gone["kind"] == "O" else "GR")
                if gone and gone["kind"] == "G" and gone["word"] in ("if", "else", "try", "catch", "finally"):
                    chain = gone["link"]
                    if chain is None:
                        chain = [("if" if gone["word"] in ("if", "else") else gone["word"], line)]
                    elif gone["word"] == "if":  # else if
                        chain = [("if", line)]
                    stack[-1]["chain"] = chain
                    nxt, _ = self.gap(at)
                    if chain[-1][0] == "try" and not _LOOK_13.match(t, nxt):
                        self.chains.append([*chain, ("other", line)])
                        stack[-1]["chain"] = None
                elif gone:
                    stack[-1]["chain"] = None
            elif s == "?":
                nxt, _ = self.gap(at)
                n1 = t[nxt : nxt + 1]
                if ts and prev in ("NAME", "OR", "BR") and n1 in (":", ",", ")", "=") and t[nxt : nxt + 2] not in ("=>", "==") or ts and top["kind"] == "C" and n1 in (";", "(", "}"):
                    continue
                top["q"] += 1
                put("?")
            elif s == ":":
                if top["q"]:
                    top["q"] -= 1
                    put("TERN")
                elif top["kind"] == "O" and prev in ("NAME", "STR", "NUM", "BR", "CONST"):
                    put(":")
                elif top["kind"] == "G" and top["stmt"] in ("case", "default"):
                    put("LAB")
                    top["stmt"] = ""
                elif ts and (prev in ("PR", "OR", "BR", "NAME", "BANG", "STR")) and (top["kind"] in ("PL", "C") or prev == "PR" or top["stmt"].split(" ")[-1] in ("const", "let", "var")):
                    e = self.type(at)
                    if e < 0:
                        self.faults.append(("type", line))
                        break
                    put("TYPE")
                    at = e
                elif top["kind"] == "G" and prev == "NAME" and len(out) > 1 and out[-2][0] in ("START", "NL", ";", "GL", "GR"):
                    put("LAB")
                else:
                    put("ANN")
            elif s == "!":
                if ts and operand and not new:
                    put("BANG")
                else:
                    put("UN")
            elif s == "~":
                put("UN")
            elif s in ("+", "-"):
                put("UN2")
            elif s in ("++", "--"):
                put("INC")
            elif s in _ASSIGN:
                put("ASG")
            elif s == "*":
                put("BIN" if operand and top["kind"] != "C" else "STAR")
            elif s in _BINARY:
                put("BIN")
            else:
                put(s)
                if s == ";":
                    top["stmt"] = top["stmt"] if top["kind"] == "PL" else ""
                    pending = ""
        line += t.count("\n", seen, min(at, end))
        put(final)
        self.targets(out)

    def word(self, w: str, put, top: dict, n1: str, t: str, nxt: int, operand: bool) -> None:
        if w in ("null", "true", "false"):
            put("CONST")
        elif w == "instanceof":
            put("BIN")
        elif w == "of" and top.get("for") and operand:
            put("of")
        elif w == "from" and top["stmt"].split(" ")[0] in ("import", "export") and n1 in "\"'":
            put("from")
        elif w == "as" and top["stmt"].split(" ")[0] in ("import", "export"):
            put("as")
        elif w == "async" and (t.startswith("function", nxt) or n1 in "(<" or n1.isalpha() or n1 in "_$") and not operand:
            put("async")
        elif w in _JS_KEYWORDS:
            put(w)
        else:
            put("NAME")


def lex_script(text: str, suffix: str) -> tuple[Sequences, list, list]:
    s = _Script(text, suffix)
    s.lex()
    return s.sequences, s.chains, s.faults


LEXERS = {"json": (lex_json, "json"), **{x: (lex_script, "script") for x in ("ts", "tsx", "js", "jsx")}}
