"""Permissible pairs of adjacent tokens, derived from grammars over token classes.

A grammar is a text of rules 'name: body'.  A body is a regular expression over token
classes and rule names with ( ) | ? * +; words between spaces are symbols.  The pairs
are LAST(x) times FIRST(y) for all x, y that can stand side by side.
"""

from __future__ import annotations

from functools import lru_cache

#: Expressions share most rules between statement kinds; NL ends a logical line, CNL is a colon with the line's end.
PYTHON = """
file: stmt * END
stmt: simple | compound
simple: small ( ; small ) * ; ? NL
small: exprs | assign | pass | break | continue | return exprs ? | del exprs | raise ( expr ( from expr ) ? ) ? | global names | nonlocal names
small: import dotted ( , dotted ) * | from ( . | ELL ) * dots ? import imports | assert expr ( , expr ) ? | TYPE NAME tparams ? = expr
dots: NAME ( . NAME ) *
dotted: dots ( as NAME ) ?
imports: * | imp ( , imp ) * | ( imp ( , imp ) * , ? )
imports: PL imp ( , imp ) * , ? PR
imp: NAME ( as NAME ) ?
names: NAME ( , NAME ) *
assign: exprs ( = exprs ) + | exprs AUG exprs | expr : expr ( = exprs ) ?
exprs: item ( , item ) * , ?
item: expr | * expr
expr: test ( := expr ) ? | lambda params ? : expr | yield ( from expr | exprs ) ?
test: disj ( if disj else expr ) ?
disj: unary ( op unary ) *
op: BIN | UN | * | ** | @ | and | or | in | not in | is | is not
unary: ( UN | not | await ) * primary
primary: atom trailer *
trailer: . NAME | call | BL subs BR
call: PL args ? PR
args: arg ( , arg ) * , ?
arg: expr | NAME = expr | * expr | ** expr | expr comp
subs: sub ( , sub ) * , ?
sub: expr | * expr | expr ? : expr ? ( : expr ? ) ?
comp: ( async ? for exprs in disj ( if disj ) * ) +
atom: NAME | CONST | NUM | STR + | BYTES + | ELL | PL PR | PL exprs comp ? PR | BL BR | BL exprs comp ? BR | CL CR | CL exprs comp ? CR | CL dict ( , dict ) * , ? CR | CL expr : expr comp CR
dict: expr : expr | ** expr
params: param ( , param ) * , ?
param: NAME ( : item ) ? ( = expr ) ? | * NAME ? ( : item ) ? | ** NAME ( : expr ) ? | BIN
tparams: BL tparam ( , tparam ) * , ? BR
tparam: NAME ( : expr ) ? ( = expr ) ? | * NAME | ** NAME
block: CNL INDENT stmt + DEDENT | : simple
compound: if expr block ( elif expr block ) * ( else block ) ? | while expr block | async ? for exprs in exprs block | async ? with withs block | try block
compound: except * ? ( exprs ( as NAME ) ? ) ? block | finally block | else block | elif expr block | MATCH exprs CNL INDENT branch + DEDENT
compound: ( @ expr NL ) * ( class DNAME tparams ? call ? block | async ? def DNAME tparams ? PL params ? PR ( ARROW exprs ) ? block )
withs: with item2 ( , item2 ) * | PL item2 ( , item2 ) * , ? PR
item2: expr ( as expr ) ?
compound: with withs2 block
withs2: item2 ( , item2 ) * | PL item2 ( , item2 ) * , ? PR
branch: CASE pats ( if expr ) ? block
pats: pat ( , pat ) * , ?
pat: expr ( as NAME ) ? | * NAME | ** NAME
"""

JSON = """
file: value END
value: STR | NUM | CONST | OL OR | OL pair ( , pair ) * OR | BL BR | BL value ( , value ) * BR
pair: KEY : value
"""

#: Braces are told apart by what they hold: GL GR blocks and class bodies, OL OR objects and patterns.  TYPE is a
#: whole type expression with the mark before it, GEN a type argument list, NL a line end that can end a statement.
SCRIPT = """
file: stmt * final ? sep END
end: ; | NL
sep: end *
stmt: sep body sep
block: GL stmt * final ? sep GR
body: simple end | block | ; | flow | func | classdef
simple: expr | decl | return expr ? | throw expr | break NAME ? | continue NAME ? | debugger | module | TYPE | do stmt while PL expr PR
decl: ( const | let | var ) bind ( , bind ) *
bind: target TYPE ? ( = assign ) ?
target: NAME | OL fields ? OR | BL elems ? BR
flow: if PL expr PR stmt ( else stmt ) ? | else stmt | for await ? PL forhead PR stmt | while PL expr PR stmt | do stmt while PL expr PR
flow: switch PL expr PR GL branch * GR | try block | catch ( PL target TYPE ? PR ) ? block | finally block | NAME LAB stmt | export ( func | classdef ) | export default ( func | classdef )
final: simple | if PL expr PR ( stmt else ) ? final | else final | for await ? PL forhead PR final | while PL expr PR final | NAME LAB final
branch: ( case expr LAB | default LAB ) stmt * final ? sep
forhead: ( const | let | var ) ? target TYPE ? ( of | in ) expr | decl ? ; expr ? ; expr ? | expr ? ; expr ? ; expr ?
module: import STR | import import_list from STR | export decl | export default assign | export OL fields ? OR ( from STR ) ? | export STAR ( as NAME ) ? from STR | export TYPE | export TYPEWORD OL fields ? OR ( from STR ) ?
import_list: TYPEWORD ? ( NAME | NAME , OL fields ? OR | OL fields ? OR | STAR as NAME | NAME , STAR as NAME )
classdef: deco * abstract ? class NAME ? GEN ? ( extends primary GEN ? ) ? TYPE ? GL sep member * field1 ? sep GR
deco: @ args ? sep
member: field1 end sep | deco * MOD * STAR ? key GEN ? params TYPE ? ( block | end ) sep | static block sep | end
field1: deco * MOD * STAR ? key TYPE ? ( = assign ) ?
key: NAME | STR | NUM | BL expr BR
func: async ? function STAR ? NAME ? GEN ? params TYPE ? ( block | end )
params: PL ( param ( , param ) * , ? ) ? PR
param: deco * MOD * ( ... ) ? target TYPE ? ( = expr ) ?
expr: assign ( , assign ) *
assign: cond | target ASG assign | cond ASG assign | cond = assign | target = assign | arrow | yield STAR ? assign ?
arrow: async ? ( NAME | GEN ? params TYPE ? ) => ( block | assign )
cond: bin ( ? assign TERN assign ) ?
bin: unary ( op unary ) * | bin TYPE
op: BIN | UN2 | in
unary: ( UN | UN2 | typeof | void | delete | await | INC ) * post
post: primary INC ?
primary: ( new primary | atom ) suffix *
suffix: . NAME | ?. ( NAME | args | BL expr BR ) | BL expr BR | GEN ? args | TPL | BANG
args: PL ( arg ( , arg ) * , ? ) ? PR
arg: ( ... ) ? assign
atom: NAME | CONST | NUM | STR | TPL | RE | JSX | PL expr PR | BL elems ? BR | OL fields ? OR | func | classdef | import args | import . NAME
elems: ( , ) * elem ( , + elem ) * ( , ) *
elem: ( ... ) ? assign
fields: field ( , field ) * , ?
field: ... assign | NAME | TYPEWORD NAME | ( NAME | CONST ) as ( NAME | default ) | default as NAME | NAME = assign | fkey : assign | MOD * STAR ? fkey GEN ? params TYPE ? block | NAME as STR
fkey: NAME | STR | NUM | BL expr BR | CONST
"""

#: What TypeScript's interfaces, enumerations and types hold.  W is a word that can stand before or between types, BAR | or &.
TYPES = """
file: body END
body: members | type | type ( , type ) *
members: { mark * ( member mark + ) * member ? }
mark: ; | , | NL
name: NAME | W
type: BAR ? unit ( ( BAR | W ) BAR ? unit ) * ( ? type : type ) ?
unit: ( W | - ) * prime post *
prime: name | STR | NUM | T | PL params PR ( => type ) ? | BL elems BR | members | < tparams > PL params PR => type
post: . name | BL type ? BR | < type ( , type ) * , ? > | PL params PR | < tparams >
params: ( param ( , param ) * , ? ) ?
param: ... ? W * ( name | members | BL elems BR | STR ) qm ? ( : type ) ? ( = value ) ? | type
tparams: W * NAME ( W type ) ? ( = type ) ? ( , W * NAME ( W type ) ? ( = type ) ? ) * , ?
elems: ( elem ( , elem ) * , ? ) ?
elem: ... ? ( name qm ? : ) ? type qm ?
qm: ?
member: W * key opt * ( < tparams > ) ? ( PL params PR ) ? ( : type ) ? | W * < tparams > PL params PR ( : type ) ? | W * PL params PR ( : type ) ? | sign ? W * BL NAME ( : | W ) type BR sign ? opt * ( : type ) ? | ... name | key = value
sign: + | -
opt: ? | !
key: name | STR | NUM | BL ( name | STR ) post * BR | # name
value: ( ~ | - | + | ! ) * operand ( oper ( ~ | - | + ) * operand ) *
oper: BAR | + | - | STAR | / | % | < < | > > | > > > | ^
operand: prime post *
"""


def _parse(text: str) -> dict[str, list]:
    """Bodies by rule; a rule's name is no token class."""
    rules: dict[str, list] = {}
    for line in text.strip().splitlines():
        name, _, body = line.partition(":")
        rules.setdefault(name.strip(), []).append(_alternatives(body.split())[0])
    return rules


def _alternatives(words: list[str], at: int = 0, depth: int = 0):
    """Nested ('alt', [('seq', [(node, mark)])]) of a body, and the place behind it."""
    alts, seq = [], []
    while at < len(words):
        w = words[at]
        if w == "(":
            node, at = _alternatives(words, at + 1, depth + 1)
            seq.append([node, ""])
        elif w == ")" and depth:
            break
        elif w == "|":
            alts.append(("seq", seq))
            seq = []
        elif w in ("?", "*", "+") and seq and not (w == "?" and words[at - 1] in ("|", "(")) and not (w == "*" and _starred(words, at)):
            seq[-1][1] = w if not seq[-1][1] else "*"
        else:
            seq.append([w, ""])
        at += 1
    alts.append(("seq", seq))
    return ("alt", alts), at


def _starred(words: list[str], at: int) -> bool:
    """Whether a * is a token: after an opening, a bar, a comma or an operator mark."""
    return words[at - 1] in ("(", "|", ",", "except") or at == 0


def _analyse(text: str) -> set[tuple[str, str]]:
    rules = _parse(text)
    first: dict[str, set] = {n: set() for n in rules}
    last: dict[str, set] = {n: set() for n in rules}
    empty: dict[str, bool] = {n: False for n in rules}
    pairs: set[tuple[str, str]] = set()

    def of(node) -> tuple[set, set, bool]:
        if isinstance(node, str):
            return (first[node], last[node], empty[node]) if node in rules else ({node}, {node}, False)
        f, ls, e = set(), set(), False
        for _, seq in node[1]:
            head, tail, none = set(), set(), True
            for item, mark in seq:
                a, z, n = of(item)
                pairs.update((x, y) for x in tail for y in a)
                if mark in ("*", "+"):
                    pairs.update((x, y) for x in z for y in a)
                n = n or mark in ("*", "?")
                head = head | a if none else head
                tail = tail | z if n else set(z)
                none = none and n
            f, ls, e = f | head, ls | tail, e or none
        return f, ls, e

    while True:
        before = (sum(map(len, first.values())), sum(map(len, last.values())), sum(empty.values()), len(pairs))
        for n, bodies in rules.items():
            for b in bodies:
                a, z, e = of(b)
                first[n] |= a
                last[n] |= z
                empty[n] |= e
        if before == (sum(map(len, first.values())), sum(map(len, last.values())), sum(empty.values()), len(pairs)):
            return pairs | {("START", x) for x in first["file"]}


@lru_cache(maxsize=4)
def permissible(language: str) -> frozenset[tuple[str, str]]:
    pairs = _analyse({"python": PYTHON, "json": JSON, "script": SCRIPT}[language])
    if language == "script":
        plain = {"PL": "(", "PR": ")", "BL": "[", "BR": "]", "STAR": "*"}
        pairs |= {(f"t.{plain.get(a, a)}", f"t.{plain.get(b, b)}") for a, b in _analyse(TYPES)}
    return frozenset(pairs)
