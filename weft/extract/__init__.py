"""Symbols and call sites of source files. A language that isn't wired (JavaScript by itself) has none."""

from __future__ import annotations

from weft.extract import clojure, python_source, scanner
from weft.extract.scanner import Call, Symbol

__all__ = ["Call", "Symbol", "extract", "extract_calls"]


def extract(language: str, source: str) -> list[Symbol]:
    """Definitions in a file, without those that have no name."""
    if language == "Python":
        return python_source.definitions(source)
    if language == "Clojure":
        return clojure.definitions(source)
    return [s for s in scanner.definitions(language, source) if s.name] if language in scanner.LANGUAGES else []


def extract_calls(language: str, source: str) -> list[Call]:
    if language == "Python":
        return python_source.calls(source)
    if language == "Clojure":
        return clojure.calls(source)
    return scanner.calls(language, source) if language in scanner.LANGUAGES else []
