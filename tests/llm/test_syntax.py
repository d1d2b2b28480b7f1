"""Syntax: agreement with the parser, statement productions, deep nesting."""

import ast
import random
import re
import time
import warnings

from srcloom.llm import lexers, syntax
from srcloom.llm.grammar import permissible
from srcloom.llm.python_lines import CLASS_NAMES, lex_python

PYTHON = """1 = x|f() = 3|x = 5 if y|f(a=1, b)|def f(a=1, b): pass|def f(*): pass|del f()|{1: 2, 3}|import a as b.c|x: int: str = 3|print(f"{a b}")|print(f"{a!r:>{w}}")|print(f"{x['a']}")|print(f"{x["a"]}")
lambda x, y=1: x|f(lambda a, b: a, *c, d=1, **k)|x = [a for a, b in c if d if e]|x = (yield)|x = yield a, b|async def f(): await x|async with a as b, c as d: pass|with (a as b, c as d): pass|with (a, b): pass|for x, *y in a, b: pass
for x in a if b else c: pass|[x for x in a if b else c]|def f(a, /, b, *, c): pass|def f(a, /, *, c=1, d, **k) -> int: pass|f(**a, *b)|f(a for a in b)|f(a for a in b, c)|f(x := 3)|x := 3|if x := 3: pass|a[1:2, ::3, ...]|a[*b]|type X = int
type X[T: int, *Ts, **P] = list[T]|type = 3|match = 4|match(x)|case = 3|x = not a in b|a + not b|- not a|x if y else lambda: z|raise A from b|assert a, b|global a, b|nonlocal x.y|from . import a|from .a.b import (c as d, e,)|from a import *|from a import (*)
return|x, y = y, x = 1, 2|x += yield|x.y[0]: int = 3|x = *a, b|*a, b = c|del a, b[0], (c, d)|@x := y|class A(B, metaclass=C): pass|class A[T](B): pass|def f[T](x: T) -> T: ...|if a: b; c; import d|if a: if b: pass|{a, *b}|{a: b for a, b in c}|{a: b, **c for x in y}
x = "\\x1"|x = b"é"|x = 012|x = 1_000_|x = 0xfg|1if x else 2|"a" b"b"|f"{lambda x: 1}"|f"{(lambda x: 1)}"|f"}"|f"{{}}"|f"{x=}"|f"{x:{y}}"|f"{}"|x = `a`|x <> y|print a|a b|a..b|a.b.|def f(**k, a): pass|def f(*, **k): pass|lambda *: 1
a if b|a and|not|a = (b = c)|f(a.b=1)|f(a=1, *b)|f(**a, b)|async x = 1|await = 3|None = 1|def None(): pass|for f() in x: pass|with a as f(): pass|with a as b.c, d as (e, f): pass|x[a:b:c:d]|x[]|x[a,]|(*a)|(*a,)|if x = 3: pass|def f()
f(a b)|f(a, , b)|f(,)|[,]|x = 1,|x = ,|import|from x import|from import y|raise a, b|return *a, b|a = b if c else d if e else f|f(a)(b)[c].d|f(a)b|3.a|x = 3 .real|class A: x = 1; y = 2"""
SCRIPT_BAD = ["f() = 3", "const x;", "interface A { 1 2 3 = = }", "enum E { a b c }", "type A = {x y z}", "class A implements 1 2 3 {}", "type X = { a: string b: number }", "x = <a><b></a></b>"]
SCRIPT_GOOD = [
    "const a = b;", "a.b = c; (a) = 3; a[0] = 1; [a,b] = c; ({a} = b);", 'enum E { A = 1 << 2, B = "x".length, C = A | B, D }', "type A<T> = T extends (infer U)[] ? U : never;", "type M = { readonly [K in keyof T]-?: T[K] extends Function ? never : K }",
    "interface X extends Y<Z> { readonly [k: string]: number; a?: () => void\n b(x: string, ...y: any[]): Promise<void>; new (x: X): Y; get z(): string; <T>(x: T): T }", "type F = (a: string, b?: number) => asserts a is string;",
    'type L = `a${B}` | "x" | -1 | typeof import("x") ;', "type T2 = [a: string, b?: number, ...rest: string[]];", "class A extends B<C> implements D, E.F<G> {}", "for (const x of y) {}", "f()[0] = 1", "const f = (a = 1) => a", "declare const x: number;",
    'type A = | "a"\n | "b"', "enum E { A, B, }", "interface A { a: string\n b: number\n c(): void\n }", "x = `a${b ? `c${d}` : e}f`", 'x = <a b="c" {...d} e={f}>it\'s {g && <b>y</b>}</a>',
]


def wrong_python(text):
    """The first fault of a text, nesting and clauses included, without Spark."""
    pairs, brackets, chains, faults = lex_python([text])
    allowed = permissible("python")
    if faults:
        return faults[0]
    for _, a, b, _ in zip(*[p.tolist() for p in pairs], strict=True):
        if (CLASS_NAMES[a], CLASS_NAMES[b]) not in allowed and (CLASS_NAMES[a], CLASS_NAMES[b]) != ("START", "END"):
            return CLASS_NAMES[a], CLASS_NAMES[b]
    open_ = []
    for c in map(chr, brackets[1].tolist()):
        if c in "([{":
            open_.append(c)
        elif not open_ or open_.pop() + c not in ("()", "[]", "{}"):
            return "nesting"
    steps = [f"{x[3]}>{y[3]}" for x, y in zip(chains, chains[1:], strict=False) if x[1] == y[1]]
    return "nesting" if open_ else next((s for s in steps if s not in syntax.CHAIN_STEPS), None)


def parses(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return False
    return True


def wrong_script(text, suffix="tsx"):
    sequences, _, faults = lexers.lex_script(text, suffix)
    return faults or [(u, v) for s in sequences for u, v in zip(s, s[1:], strict=False) if (u[0], v[0]) not in permissible("script") and (u[0], v[0]) != ("START", "END")]


def test_python_statements_agree_with_the_parser():
    for text in PYTHON.replace("\n", "|").split("|"):
        assert (wrong_python(text) is None) == parses(text), text


def test_mutated_python_agrees_with_the_parser():
    """Files of this package with one token changed: no valid one is flagged, hardly an invalid one missed."""
    rng, texts, missed = random.Random(3), [], 0
    for module in (syntax, lexers):
        with open(module.__file__, encoding="utf-8") as f:
            texts += ["\n".join(part) for part in [f.read().split("\n")]]
    words = "( ) [ ] { } , : = == if else for in lambda * ** . not x 3 def return import as del @ -> ; is + try except with".split() + ["\n", "\n    ", '"s"', 'f"{x}"', "1 = x"]
    for text in texts:
        assert wrong_python(text) is None
    for _ in range(300):
        parts = re.findall(r"\w+|\s+|[^\w\s]", rng.choice(texts))
        at, kind = rng.randrange(len(parts)), rng.random()
        if kind < 0.4:
            parts[at] = rng.choice(words)
        elif kind < 0.7:
            parts.insert(at, rng.choice(words))
        else:
            del parts[at]
        text = "".join(parts)
        if parses(text):
            assert wrong_python(text) is None
        else:
            missed += wrong_python(text) is None
    assert missed <= 2


def test_script_statements_and_types():
    for text in SCRIPT_BAD:
        assert wrong_script(text), text
    for text in SCRIPT_GOOD:
        assert not wrong_script(text), text


def test_deep_nesting_needs_no_recursion():
    assert not wrong_script("x = " + "<a>" * 3000 + "</a>" * 3000, "jsx")
    assert not wrong_script("x = " + "<a>{" * 1000 + "1" + "}</a>" * 1000, "jsx")
    assert not wrong_script("x = " + "`${" * 1000 + "1" + "}`" * 1000, "ts")
    assert not wrong_script("type X = " + "() => " * 3000 + "void", "ts")
    assert wrong_script("x = " + "<a>" * 3000 + "</a>" * 2999, "jsx")
    assert not wrong_script("type X = " + "A extends B ? " * 2000 + "C" + " : D" * 2000, "ts")
    assert wrong_script("type X = " + "A extends B ? " * 2000 + "C" + " : D" * 1999, "ts")


def test_odd_texts_take_no_longer_than_others():
    began = time.process_time()
    assert wrong_python("{" * 20_000 + "}" * 20_000) is not None and wrong_python("(" * 150 + ")" * 150) is None
    assert wrong_script("a<" * 20_000, "ts")
    for text in ("(" * 20_000, '"""' * 5001, 'f"{' * 3000, "`${" * 5000, "/*" * 20_000, "@" * 20_000, "\\\n" * 20_000, "<a " * 20_000):
        wrong_python(text), wrong_script(text, "tsx")
    assert time.process_time() - began < 20
