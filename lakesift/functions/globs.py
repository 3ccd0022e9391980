"""File globs as regular expressions that Java, Python and RE2 read alike."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """The anchored regular expression of a glob.

    ``*`` and ``?`` also match ``/``; a leading ``**/`` matches any or no folders, ``/**`` everything below, ``{a,b}`` either.
    """
    out, i, depth = [], 0, 0
    g = glob.replace("\\", "/")
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i) and (i == 0 or g[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if g.startswith("/**/", i):
            out.append("/(?:.*/)?")
            i += 4
            continue
        if c == "*":
            while i + 1 < len(g) and g[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in g[i + 1 :]:
            j = g.index("]", i + 1)
            inner = g[i + 1 : j]
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + ")" * depth + "$"
