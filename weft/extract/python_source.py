"""Definitions and calls in Python, by its own parser; by lines where a file doesn't parse."""

from __future__ import annotations

import ast
import re

from weft.extract.scanner import Call, Symbol


def definitions(src: str) -> list[Symbol]:
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return by_lines(src)
    lines, out = src.split("\n"), []

    def visit(node: ast.AST, scope: tuple[str, ...], in_class: bool) -> None:
        for kid in ast.iter_child_nodes(node):
            if isinstance(kid, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                of_class = isinstance(kid, ast.ClassDef)
                kind = "Class" if of_class else "Method" if in_class else "Function"
                row = lines[kid.lineno - 1].encode()
                at = row.find(kid.name.encode(), kid.col_offset + 3)
                out.append(Symbol(kid.name, "/".join((*scope, kid.name)), kind, kid.lineno, kid.col_offset, kid.end_lineno, kid.end_col_offset, kid.lineno, max(at, 0)))
                visit(kid, (*scope, kid.name) if of_class else scope, of_class)
            else:
                visit(kid, scope, in_class)

    visit(tree, (), False)
    return out


DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")


def by_lines(src: str) -> list[Symbol]:
    """For files with syntax errors: each def and class up to the next line that isn't deeper."""
    lines, out, open_ = src.split("\n"), [], []
    for i, line in enumerate(lines):
        if m := DEF.match(line):
            indent = len(m[1].expandtabs())
            while open_ and open_[-1][0] >= indent:
                open_.pop()
            scope = tuple(n for _, n, c in open_ if c)
            in_class = bool(open_) and open_[-1][2]
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= len(m[1])), len(lines))
            while end > i + 1 and not lines[end - 1].strip():
                end -= 1
            kind = "Class" if m[2] == "class" else "Method" if in_class else "Function"
            out.append(Symbol(m[3], "/".join((*scope, m[3])), kind, i + 1, len(m[1].encode()), end, len(lines[end - 1].encode()), i + 1, len(line[: m.start(3)].encode())))
            open_.append((indent, m[3], m[2] == "class"))
    return out


def calls(src: str) -> list[Call]:
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [Call(m[1], i, len(line[: m.start(1)].encode())) for i, line in enumerate(src.split("\n"), 1) if not DEF.match(line) for m in re.finditer(r"(\w+)\(", line)]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.append(Call(name, node.lineno, node.col_offset))
    return sorted(out, key=lambda c: (c.line, c.col, c.name))
