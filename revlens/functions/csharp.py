"""Lexical view of C# text for the rules R1-R3: a helper for one file's text.

There is no parser. The text is cut into tokens (comments, strings and
preprocessor lines are skipped, the holes of interpolated strings are code), and
one walk over the tokens keeps the open braces with what they belong to: a type,
a method body, or anything else. Outside of a type (a diff seldom shows the
class line) declarations count as members. Functions inside a method body are
local and not reported. A brace in a method body opens a block behind a control
statement's parentheses, a block keyword or the head of a local function, else an
initialiser, a lambda or a pattern, with which the statement goes on.
"""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation
from math import isinf
from typing import NamedTuple

# --- fixed values ---------------------------------------------------------------
MODIFIERS = frozenset(
    "public private protected internal static override virtual abstract sealed new unsafe extern async partial readonly".split()
)
TYPE_WORDS = frozenset("class struct interface record enum namespace".split())
STATEMENT_WORDS = frozenset(
    "if for foreach while do switch try catch finally using lock fixed return throw await yield else goto case default break "
    "continue checked unchecked base this var".split()
)
#: Statements whose parentheses stand before a block, and words right before one.
CONTROL_WORDS = frozenset("if for foreach while switch catch using lock fixed when".split())
BLOCK_WORDS = frozenset("else do try catch finally unsafe checked unchecked".split())
INTEGER_LIMIT = (1 << 64) - 1
DECIMAL_LIMIT = (1 << 96) - 1
SINGLE_LIMIT = 3.4028235677973366e38
# ----------------------------------------------------------------------------------

# Words and common marks come first: nothing else begins as they do.
_TOKEN = re.compile(
    r"""
    (?P<word>@?[^\W\d]\w*)
  | (?P<sign>[(){}\[\];,<>])
  | (?P<skip>(?:^[ \t]*\#[^\r\n]* | \n+ | [^\S\n]+ | //[^\r\n]* | /\*.*?(?:\*/|\Z))++)
  | (?P<raw>\$*(?P<q>"{3,}).*?(?:(?P=q)"*|\Z))
  | (?P<inter>\$@?"|@\$")
  | (?P<string>@"(?:[^"]|"")*(?:"|\Z) | "(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z) | '(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))
  | (?P<number>0[xX][0-9a-fA-F_]+[uUlL]* | 0[bB][01_]+[uUlL]*
      | (?:\d[\d_]*(?:\.\d[\d_]*)? | \.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDmMuUlL]*)
  | (?P<mark>=> | \.\. | \?\? | .)
    """,
    re.S | re.X | re.M,
)


class Token(NamedTuple):
    kind: str  # number, word or mark
    text: str
    at: int


class Found(NamedTuple):
    rule: str  # async_void, literal or long_method
    at: int  # offset in the text
    text: str  # method name, literal value or statement count


def _interpolated(text: str, i: int, verbatim: bool) -> tuple[list[tuple[int, int]], int]:
    """Code ranges in the holes of an interpolated string that opens before i,
    and the offset after it."""
    holes, depth, start, n = [], 0, 0, len(text)
    while i < n:
        c = text[i]
        if not depth:
            if c == '"' and not (verbatim and text[i + 1 : i + 2] == '"'):
                return holes, i + 1
            if c == "\n" and not verbatim:
                return holes, i
            if c in "{}" and text[i + 1 : i + 2] == c or c == '"' or c == "\\" and not verbatim:
                i += 1
            elif c == "{":
                depth, start = 1, i + 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                if start >= 0:
                    holes.append((start, i))
        elif c == ":" and depth == 1 and start >= 0:  # a format text follows
            holes.append((start, i))
            start = -1
        elif c == '"' and start >= 0:
            inner = re.compile(r'"(?:[^"\\\n]|\\.)*"').match(text, i)
            i = inner.end() - 1 if inner else i
        i += 1
    return holes, n


def _raw_holes(text: str, low: int, high: int, width: int) -> list[tuple[int, int]]:
    """Code ranges in the holes of a raw interpolated string: `width` braces each."""
    holes, i = [], low
    while 0 <= (i := text.find("{" * width, i, high)):
        while text[i + width : i + width + 1] == "{":  # the innermost braces of a run open the hole
            i += 1
        depth, start, j = 1, i + width, i + width
        while j < high and depth:
            depth += {"{": 1, "}": -1}.get(text[j], 0)
            j += 1
        holes.append((start, j - 1 if not depth else high))
        i = j - 1 + width if not depth else high
    return holes


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    todo: list[Token | tuple[int, int]] = [(0, len(text))]  # code ranges still to be read, the next one last
    while todo:
        part = todo.pop()
        if isinstance(part, Token):
            out.append(part)
            continue
        low, high = part
        while low < high:
            for m in _TOKEN.finditer(text, low, high):  # every character belongs to a match
                kind, low = m.lastgroup, m.end()
                if kind == "skip":
                    continue
                if kind == "word":
                    out.append(Token("word", m[0], m.start()))
                    continue
                if kind == "sign" or kind == "mark":
                    out.append(Token("mark", m[0], m.start()))
                    continue
                if kind == "number":
                    if m[0].startswith(".") and out and out[-1].at + len(out[-1].text) == m.start() and out[-1].kind == "word":
                        out.append(Token("mark", ".", m.start()))  # a member, not a fraction
                        low = m.start() + 1
                        break  # go on behind the point
                    out.append(Token(kind, m[0], m.start()))
                    continue
                if kind == "string":
                    out.append(Token("string", '"', m.start()))
                    continue
                holes: list[tuple[int, int]] = []
                if kind == "inter":
                    holes, low = _interpolated(text, low, "@" in m[0])
                else:
                    dollars = len(m[0]) - len(m[0].lstrip("$"))
                    holes = _raw_holes(text, m.start("q") + len(m["q"]), low, dollars) if dollars else []
                if holes:
                    todo.append((low, high))
                    for a, b in reversed(holes):
                        todo += [Token("mark", ")", b), (a, min(b, high)), Token("mark", "(", a)]
                    low = high
                elif kind != "inter":
                    out.append(Token("string", '"', m.start()))
                break  # go on behind the string
    return out


def literal_value(token: str) -> str:
    """Value text of a numeric literal: integers in decimal, reals in shortest
    form with an exponent from 15 digits or below 0.0001, decimals as written.
    What no type holds has the value a compiler falls back on: 0 for integers
    (also those without digits) and decimals, Infinity for reals."""
    t = token.lower().replace("_", "")
    if t[:2] in ("0x", "0b"):
        digits = t[2:].rstrip("ul")
        value = int(digits, 16 if t[1] == "x" else 2) if digits and len(digits) <= 128 else 0
        return str(value) if value <= INTEGER_LIMIT else "0"
    number = t.rstrip("fdmul")
    if number.isdigit() and not t.endswith(("f", "d", "m")):
        number = number.lstrip("0")
        return number if number and (len(number), number) <= (20, str(INTEGER_LIMIT)) else "0"
    if t.endswith("m"):
        try:
            value = Decimal(number)
        except InvalidOperation:  # an exponent of 19 digits or more
            return "0"
        return format(value, "f") if value.adjusted() < 30 and value.copy_abs() <= DECIMAL_LIMIT and value.as_tuple().exponent > -400 else "0"
    real = float(number)
    if isinf(real) or t.endswith("f") and real > SINGLE_LIMIT:
        return "Infinity"
    value = Decimal(repr(real)).normalize()
    sign, digits, shift = value.as_tuple()
    exponent = len(digits) - 1 + shift
    if value and (exponent >= 15 or exponent < -4):
        mantissa = str(digits[0]) + ("." + "".join(map(str, digits[1:])) if len(digits) > 1 else "")
        return f"{mantissa}E{'+' if exponent >= 0 else '-'}{abs(exponent):02d}"
    return format(value, "f") if value else "0"


class _Scope:
    """An open brace: what it belongs to, and a method body's statements."""

    def __init__(self, kind: str, start: int = 0, name: str = ""):
        self.kind, self.start, self.name = kind, start, name
        self.statements, self.first = 0, ""
        self.block = True  # of a statement, not of an expression
        self.head: list[Token] = []  # the statement so far
        self.opened: list[str] = []  # the word before each open parenthesis
        self.closed = ""  # the word before the parentheses closed last

    def next_statement(self) -> None:
        self.statements, self.first, self.head, self.opened, self.closed = self.statements + 1, "", [], [], ""

    def opens_block(self) -> bool:
        """Whether a brace here, outside of parentheses, opens a block."""
        before = self.head[-1].text if self.head else ""
        if before == ")" and self.closed in CONTROL_WORDS or before in BLOCK_WORDS or before in ("", ":"):
            return True
        return _method(self.head) is not None



def _method(head: list[Token]) -> tuple[str, bool] | None:
    """(name, is async void) if the tokens before a body or `;` are a method's head."""
    k = 0
    while k < len(head) and head[k].text == "[":  # attributes
        depth = 0
        while k < len(head):
            depth += {"[": 1, "]": -1}.get(head[k].text, 0)
            k += 1
            if not depth:
                break
    modifiers = set()
    while k < len(head) and head[k].text in MODIFIERS:
        modifiers.add(head[k].text)
        k += 1
    angle, parts = 0, []
    for j in range(k, len(head)):
        t = head[j].text
        if t == "(" and not angle and parts and head[j - 1].text not in (",", "<"):
            break
        angle += {"<": 1, ">": -1}.get(t, 0)
        if head[j].kind not in ("word", "mark") or t in ("=", ";", "{", "}", "=>"):
            return None
        if t == "(":  # a tuple as the return type
            angle += 1
        elif t == ")":
            angle -= 1
        parts.append(head[j])
    else:
        return None
    while parts and parts[-1].text == ">":  # type parameters of the method
        depth = 0
        while parts:
            depth += {">": 1, "<": -1}.get(parts.pop().text, 0)
            if not depth:
                break
    if len(parts) < 2 or parts[-1].kind != "word":
        return None
    if parts[0].text in STATEMENT_WORDS or any(p.text in TYPE_WORDS or p.text == "operator" for p in parts):
        return None
    name = parts.pop().text
    while parts and parts[-1].text == ".":  # the interface that an explicit implementation names
        parts.pop()
        depth = 0
        while parts and (parts[-1].text == ">" or depth):
            depth += {">": 1, "<": -1}.get(parts.pop().text, 0)
        if not parts or parts.pop().kind != "word":
            return None
    return (name, "async" in modifiers and [p.text for p in parts] == ["void"]) if parts else None


def scan(text: str, max_statements: int) -> list[Found]:
    """Async void methods, numeric literals and long methods, in text order."""
    toks = tokens(text)
    found = [Found("literal", t.at, literal_value(t.text)) for t in toks if t.kind == "number"]
    scopes, head, depth = [_Scope("type")], [], 0  # head: tokens since the last boundary

    def close(scope: _Scope) -> None:
        if scope.kind == "method" and scope.statements + bool(scope.first) > max_statements:
            found.append(Found("long_method", scope.start, str(scope.statements + bool(scope.first))))

    for i, t in enumerate(toks):
        scope, after = scopes[-1], toks[i + 1].text if i + 1 < len(toks) else ""
        if scope.kind == "type":
            ends = t.text in ("{", "}", ";", "=>") and not depth
            depth = max(0, depth + {"(": 1, ")": -1}.get(t.text, 0)) if t.kind == "mark" else depth
            if not ends:
                head.append(t)
                continue
            method = _method(head) if t.text != "}" else None
            if method and method[1]:
                found.append(Found("async_void", head[0].at, method[0]))
            if t.text == "{":
                if method:
                    scopes.append(_Scope("method", head[0].at, method[0]))
                else:
                    words = {h.text for h in head if h.kind == "word"}
                    scopes.append(_Scope("type" if words & TYPE_WORDS or not head else "other"))
            elif t.text == "}" and len(scopes) > 1:
                scopes.pop()
            elif t.text == "=>":
                scopes.append(_Scope("arrow"))
            head, depth = [], 0
        elif scope.kind == "arrow":  # an expression body, up to its `;`
            depth += {"(": 1, "{": 1, ")": -1, "}": -1}.get(t.text, 0) if t.kind == "mark" else 0
            if t.text == ";" and depth <= 0:
                scopes.pop()
                head, depth = [], 0
        elif t.text == "{":
            inner = _Scope("other")
            if scope.kind == "method":
                inner.block = not depth and scope.opens_block()
                scope.first = scope.first or t.text
                scope.head.append(t)
            scopes.append(inner)
        elif t.text == "}":
            scopes.pop()
            close(scope)
            outer = scopes[-1]
            if outer.kind == "method" and not depth and scope.block:
                if after not in ("else", "catch", "finally") and not (after == "while" and outer.first == "do"):
                    outer.next_statement()
        elif scope.kind == "method":
            scope.first = scope.first or t.text
            if t.kind == "mark" and t.text in "([":
                scope.opened.append(scope.head[-1].text if scope.head else "")
                depth += 1
            elif t.kind == "mark" and t.text in ")]":
                scope.closed = scope.opened.pop() if scope.opened else ""
                depth = max(0, depth - 1)
            done = scope.closed == "while" and scope.head[-1:] and scope.head[-1].text == ")"  # the end of a do statement
            scope.head.append(t)
            if t.text == ";" and not depth and after != "else" and (done or not (after == "while" and scope.first == "do")):
                scope.next_statement()
    for scope in reversed(scopes):
        close(scope)
    if scopes[-1].kind == "type" and head:
        method = _method(head)
        if method and method[1]:
            found.append(Found("async_void", head[0].at, method[0]))
    return sorted(found, key=lambda f: (f.at, f.rule))
