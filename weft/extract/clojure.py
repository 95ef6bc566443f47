"""Definitions and calls in Clojure, by reading its lists."""

from __future__ import annotations

import re

from weft.extract.scanner import Call, Places, Symbol

# What each defining form defines.
FORMS = {
    "ns": "Module", "def": "Const", "defonce": "Const", "defn": "Function", "defn-": "Function", "defmulti": "Function", "defmethod": "Function", "defmacro": "Macro",
    "defrecord": "Struct", "deftype": "Struct", "defprotocol": "Struct", "defstruct": "Struct",
}
TOKEN = re.compile(r""";[^\n]*|"(?:\\.|[^"\\])*"|\\\w+|\\.|[()\[\]{}]|\^(?:\{[^}]*\}|[^\s()\[\]{}"]+)|[^\s()\[\]{}";,]+""", re.S)


def lists(src: str):
    """(begin, end, head, its place, second symbol, its place, depth) of each list, in order of begin."""
    stack, out = [], []
    for m in TOKEN.finditer(src):
        t = m[0]
        if t[0] in ";\"\\^":
            continue
        if t in "([{":
            stack.append([t, m.start(), []])
        elif t in ")]}":
            if stack:
                kind, begin, words = stack.pop()
                if kind == "(" and words:
                    out.append((begin, m.end(), words, len(stack)))
        elif stack and len(stack[-1][2]) < 2:
            stack[-1][2].append((t, m.start()))
    while stack:
        kind, begin, words = stack.pop()
        if kind == "(" and words:
            out.append((begin, len(src), words, len(stack)))
    return sorted(out)


def definitions(src: str) -> list[Symbol]:
    place, scope, out = Places(src), (), []
    for begin, end, words, _ in lists(src):
        if words[0][0] not in FORMS or len(words) < 2:
            continue
        name, at = words[1]
        kind = FORMS[words[0][0]]
        own = () if kind == "Module" else scope
        out.append(Symbol(name, "/".join((*own, name)), kind, *place(begin), *place(end), *place(at)))
        if kind == "Module":
            scope = (name,)
    return out


def calls(src: str) -> list[Call]:
    place = Places(src)
    return [Call(words[0][0].rsplit("/", 1)[-1] or words[0][0], *place(words[0][1])) for begin, end, words, _ in lists(src) if words[0][0] not in FORMS and not re.match(r"[:'`#@&\d]", words[0][0])]
