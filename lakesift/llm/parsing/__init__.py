"""Lexers, grammars and a table-driven parser for the languages of parsed files."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from lakesift.llm.parsing import grammars, lr, python
from lakesift.llm.parsing.lexers import LexError, Lexer, languages

# The language of each extension.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "py": "python", "go": "go", "java": "java", "cs": "csharp",
}


@dataclass(frozen=True)
class Fault:
    """The first place at which a file stops being a sentence of its language."""

    line: int
    column: int
    what: str


@cache
def parser(language: str) -> tuple[Lexer | python.PythonLexer, lr.Tables]:
    """Lexer and tables of a language, built once per process."""
    if language == "python":
        tables = lr.build(python.GRAMMAR, python.CONTEXTUAL)
        return python.PythonLexer(tables), tables
    text, contextual = {
        "javascript": (grammars.JAVASCRIPT, grammars.JS_CONTEXTUAL),
        "typescript": (grammars.TYPESCRIPT, grammars.TS_CONTEXTUAL),
        "go": (grammars.GO, set()),
        "java": (grammars.JAVA, grammars.JAVA_CONTEXTUAL),
        "csharp": (grammars.CSHARP, grammars.CSHARP_CONTEXTUAL),
    }[language]
    tables = lr.build(text, contextual)
    return Lexer(language, languages()[language], tables), tables


def language_of(path: str | None) -> str | None:
    """The language the extension of a path stands for (case ignored)."""
    m = re.search(r"\.(\w+)\s*$", (path or "").lower())
    return EXTENSIONS.get(m[1]) if m else None


def _at(text: str, offset: int, what: str) -> Fault:
    line = text.count("\n", 0, offset) + 1
    return Fault(line, offset - text.rfind("\n", 0, offset), what)


def _return_outside(tables: lr.Tables, tokens: list) -> int | None:
    """Index of a ``return`` outside all braces: scripts allow it in functions only."""
    opening, closing, word = (tables.terminals[f"'{t}'"] for t in ("{", "}", "return"))
    depth = 0
    for i, (kinds, _, _) in enumerate(tokens):
        k = kinds[0]
        if k == opening:
            depth += 1
        elif k == closing:
            depth -= 1
        elif k == word and depth <= 0:
            return i
    return None


def first_fault(source: str, language: str) -> Fault | None:
    """The first fault of a source in a language, or None if it is valid."""
    text = source.replace("\r\n", "\n").replace("\r", "\n")
    lexer, tables = parser(language)
    try:
        tokens = lexer.tokens(text)
    except LexError as e:
        return _at(text, e.at, e.what)
    except RecursionError:
        return _at(text, 0, "nested too deeply")
    inserted = closers = None
    if lexer.script:
        inserted, closers = lexer.semicolon[0], frozenset((tables.terminals["'}'"], 0))
    wrong = lr.first_error(tables, tokens, inserted, closers or frozenset())
    outside = _return_outside(tables, tokens) if lexer.script else None
    if outside is not None and (wrong is None or outside < wrong):
        return _at(text, tokens[outside][1], "return outside a function")
    if wrong is None:
        return None
    at = tokens[wrong][1]
    near = re.match(r"\w+|\S?", text[at : at + 40])
    return _at(text, min(at, len(text)), f"unexpected {near[0]!r}" if near and near[0] else "unexpected end")
