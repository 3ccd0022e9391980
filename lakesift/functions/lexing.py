"""Facts of one source file: names, string literals, calls, imports, exports and faults, in the order of the text.

Python is read through the interpreter's syntax tree. The other five languages are read as tokens; what a name is (declaration, parameter,
member, key) follows from the tokens around it. Order matters to what comes later (the first fact wins), so facts carry their place in order.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, field

from lakesift.rules import hints

MAX_FAULTS = 5
MIN_LITERAL_BYTES = 5
# Words that are never names of data, and methods of Python's own types.
NO_NAMES = set("true false null undefined None True False self cls this new typeof instanceof".split())
BUILTIN_METHODS = set(
    "append extend insert remove pop clear sort reverse copy get items keys values update join split strip lstrip rstrip replace format encode decode lower upper startswith "
    "endswith find count index read write close open add discard union".split()
)
KEYWORDS = set(
    "abstract as async await base bool boolean break byte case catch char class const continue debugger decimal declare default defer delegate delete do double else enum event export "
    "extends final finally fixed float for foreach from func function get global go goto if implements import in int interface internal is let lock long map module namespace native object of "
    "operator out override package params private protected public range readonly record ref return sbyte sealed select set short sizeof static string struct super switch synchronized "
    "throw throws transient try type uint ulong unchecked unsafe ushort using var virtual void volatile when where while with yield chan fallthrough".split()
)
GO_KEYWORDS = set(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
# What may stand in a script's import before its source, and words that begin another statement.
IMPORT_OPS = set("{ } , * = ( ) .".split())
IMPORT_WORDS = set("import type from as require".split())
OTHER_STATEMENTS = set("import export const let var function class interface enum if for while do return switch try throw".split())
TYPE_WORDS = set("bool boolean byte char decimal double float int long object sbyte short string uint ulong ushort var void String Object".split())

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>\"\"\".*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)|(?P<num>\d[\w.]*)|"
    r"(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>=>|\?\.|\?\?|:=|::|->|\.\.\.|[^\s\w])",
    re.S,
)


# What stands before an object that is a value, and before a member of a class.
BEFORE_OBJECT = {"(", ",", "=", ":", "return", "[", "?", "??", "||", "&&"}
MEMBER_STARTS = {"{", ";", "}", "private", "public", "protected", "readonly", "static", "declare", "override", "abstract"}
NO_CALLEES = {"function", "func", "def", "class", "record", "new"}
_PAD = 4


@dataclass
class Facts:
    identifiers: list[dict] = field(default_factory=list)
    literals: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    exports: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)

    def name(self, name: str, line: int, column: int, context: str) -> None:
        if name and name not in NO_NAMES:
            self.identifiers.append({"ord": len(self.identifiers), "name": name, "line": line, "column": column, "context": context})

    def literal(self, value: str, line: int, column: int) -> None:
        if len(value.encode("utf-8", "replace")) >= MIN_LITERAL_BYTES:
            self.literals.append({"ord": len(self.literals), "value": value, "line": line, "column": column})

    def call(self, callee: str, line: int, column: int, args: list[str]) -> None:
        self.calls.append({"ord": len(self.calls), "callee": callee, "line": line, "column": column, "argument_identifiers": [a for a in args if a not in NO_NAMES]})

    def imported(self, source: str, line: int, specifiers: list[tuple[str, str, str]]) -> None:
        self.imports.append({"ord": len(self.imports), "source": source, "line": line, "specifiers": [{"kind": k, "local": a, "imported": b} for k, a, b in specifiers]})

    def exported(self, name: str, kind: str, line: int, source: str | None = None) -> None:
        self.exports.append({"ord": len(self.exports), "name": name, "kind": kind, "reexport_source": source, "line": line})

    def fault(self, line: int | None, message: str, hint: str | None) -> None:
        if len(self.warnings) < MAX_FAULTS:
            self.warnings.append({"line": line, "message": message, "hint": hint})


def facts_of(source: str, language: str) -> Facts:
    """All facts of a source."""
    return _python(source) if language == "python" else _tokens(source, language)


# Python ------------------------------------------------------------------------------------------------------------------


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return ""


def _arguments(node: ast.Call) -> list[str]:
    out: list[str] = []
    for part in [*node.args, *(k.value for k in node.keywords)]:
        for x in _preorder(part):
            if isinstance(x, ast.Attribute):
                out += [t for t in (_dotted(x), x.attr) if t]
            elif isinstance(x, ast.Name):
                out.append(x.id)
    return out


def _preorder(node: ast.AST):
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        inner: list[ast.AST] = []
        for name in n._fields:
            if name != "ctx":
                value = getattr(n, name, None)
                if value.__class__ is list:
                    inner += [x for x in value if isinstance(x, ast.AST)]
                elif isinstance(value, ast.AST):
                    inner.append(value)
        inner.reverse()
        stack += inner


def _python(source: str) -> Facts:
    f = Facts()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        at, lines = getattr(e, "lineno", None), source.split("\n")
        f.fault(at, getattr(e, "msg", None) or str(e), _hint(lines[at - 1] if at and at <= len(lines) else ""))
        return _tokens(source, "python", f)
    lines = source.split("\n")

    def column(n: ast.AST) -> int:
        line = lines[n.lineno - 1] if n.lineno <= len(lines) else ""
        return n.col_offset + 1 if line.isascii() else len(line.encode()[: n.col_offset].decode("utf-8", "replace")) + 1

    for n in _preorder(tree):
        t = n.__class__
        if t is ast.Attribute:
            if n.attr not in BUILTIN_METHODS:
                f.name(n.attr, n.end_lineno or n.lineno, (n.end_col_offset or 0) - len(n.attr) + 1, "PropertyAccess")
        elif t is ast.Constant:
            if isinstance(n.value, str):
                f.literal(n.value, n.lineno, column(n))
        elif t is ast.Call:
            callee = _dotted(n.func)
            if callee:
                f.call(callee, n.lineno, column(n), _arguments(n))
        elif t in (ast.Assign, ast.AugAssign, ast.AnnAssign):
            for target in n.targets if t is ast.Assign else [n.target]:
                for x in target.elts if isinstance(target, (ast.Tuple, ast.List)) else [target]:
                    if isinstance(x, ast.Name):
                        f.name(x.id, x.lineno, column(x), "VariableDecl")
        elif t is ast.arg:
            f.name(n.arg, n.lineno, column(n), "Parameter")
        elif t is ast.Dict:
            for k in n.keys:
                if isinstance(k, ast.Constant) and isinstance(k.value, str) and k.value.isidentifier():
                    f.name(k.value, k.lineno, column(k), "PropertyDef")
        elif t is ast.Import:
            for a in n.names:
                f.imported(a.name, n.lineno, [("namespace", a.asname or a.name, "*")])
        elif t is ast.ImportFrom:
            module = "." * n.level + (n.module or "")
            specs = [("namespace", "*", "*") if a.name == "*" else ("named", a.asname or a.name, a.name) for a in n.names]
            f.imported(module, n.lineno, specs)
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and not n.name.startswith("_"):
            f.exported(n.name, "named", n.lineno)
        elif isinstance(n, ast.ClassDef):
            f.exported(n.name, "named", n.lineno)
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Name) and not t.id.startswith("_"):
                    f.exported(t.id, "named", n.lineno)
    return f


# The other languages -----------------------------------------------------------------------------------------------------


def _hint(line: str) -> str:
    """What the line of a fault suggests."""
    if "=>" in line and "(" not in line:
        return hints.ARROW
    for opening, closing, advice in hints.BRACKETS:
        if line.count(opening) != line.count(closing):
            return advice
    return hints.COMMA if line.rstrip().endswith(",") else hints.OTHERWISE


def _tokens(source: str, language: str, facts: Facts | None = None) -> Facts:
    f = facts or Facts()
    script = language in ("typescript", "javascript")
    toks: list[tuple[str, str, int, int]] = []
    line, line_start, at = 1, 0, 0
    count = source.count
    for m in _TOKEN.finditer(source):
        start = m.start()
        breaks = count("\n", at, start)
        if breaks:
            line += breaks
            line_start = source.rfind("\n", at, start) + 1
        at = start
        k = m.lastgroup
        if k != "comment":
            toks.append((k, m.group(), line, start - line_start + 1))
    kinds = [x[0] for x in toks] + [""] * _PAD  # what lies before the first or behind the last token reads as ''
    texts = [x[1] for x in toks] + [""] * _PAD
    keywords = GO_KEYWORDS if language == "go" else KEYWORDS
    match = _pairs(toks, f, source)
    roles = _roles(toks, texts, match, language)
    java = language == "java"
    for i, (k, t, ln, col) in enumerate(toks):
        if k == "word":
            before = texts[i - 1]
            member = before == "." or before == "?."
            if not member and t in keywords:
                continue
            role = roles.get(i)
            called = texts[i + 1] == "("
            if role is None:
                if member:
                    if not (java and called):
                        f.name(t, ln, col, "PropertyAccess")
                    elif t.startswith("get") and len(t) > 3:
                        f.name(t[3].lower() + t[4:], ln, col, "PropertyAccess")
            elif role != "Method":
                f.name(t, ln, col, role)
            if called and role != "Method" and before not in NO_CALLEES:
                callee, j = t, i
                while texts[j - 1] in (".", "?.") and kinds[j - 2] == "word":
                    callee = f"{texts[j - 2]}.{callee}"
                    j -= 2
                args: list[str] = []
                end = match.get(i + 1, i + 1)
                for x in range(i + 2, end):
                    if kinds[x] == "word" and texts[x] not in keywords and texts[x - 1] not in (".", "?."):
                        if texts[x + 1] not in (".", "?."):
                            args.append(texts[x])
                            continue
                        chain = [texts[x]]
                        y = x
                        while texts[y + 1] in (".", "?.") and kinds[y + 2] == "word":
                            chain.append(texts[y + 2])
                            y += 2
                        args += [".".join(chain), chain[-1]] if len(chain) > 1 else chain
                f.call(callee, toks[j][2], toks[j][3], args)
        elif k == "str":
            body = t[3:].removesuffix('"""') if t.startswith('"""') else t[1:-1] if len(t) > 1 and t[-1] == t[0] else t[1:]
            f.literal(body, ln, col)
    if script:
        _script_modules(toks, match, f)
    elif language == "go":
        _go_modules(toks, match, f)
    elif language in ("java", "csharp"):
        _class_modules(source, toks, match, f, language)
    return f


def _pairs(toks: list, f: Facts, source: str) -> dict[int, int]:
    """Closing place of each opening bracket; brackets that do not match are faults."""
    closing = {"(": ")", "[": "]", "{": "}"}
    stack: list[int] = []
    out: dict[int, int] = {}
    lines: list[str] = []

    def fault(line: int, message: str) -> None:
        if len(f.warnings) < MAX_FAULTS:
            if not lines:
                lines.extend(source.split("\n"))
            f.fault(line, message, _hint(lines[line - 1]))

    for i, (k, t, ln, _) in enumerate(toks):
        if k != "op":
            continue
        if t in closing:
            stack.append(i)
        elif t in closing.values():
            if stack and closing[toks[stack[-1]][1]] == t:
                out[stack.pop()] = i
            else:
                fault(ln, f"syntax error near `{t}`")
    for i in stack:
        fault(toks[i][2], f"`{toks[i][1]}` is not closed")
        out[i] = len(toks)
    return out


def _level(texts: list[str], match: dict[int, int], opening: int):
    """Places of the tokens right inside a bracket, not in brackets within it."""
    x, end = opening + 1, min(match.get(opening, opening), len(texts))
    while x < end:
        yield x
        x = match.get(x, x) + 1


def _class_fields(toks: list, texts: list[str], match: dict[int, int], at: int, word, roles: dict[int, str]) -> None:  # noqa: ANN001
    """Fields of a class body: names that begin a member and are followed by a type, a value or its end."""
    x, angles = at + 1, 0
    while x < len(toks) and (angles > 0 or texts[x] not in ("{", ";", ")")):
        angles += (texts[x] == "<") - (texts[x] == ">")
        x = match.get(x, x) + 1
    if texts[x] == "{":
        for y in _level(texts, match, x):
            begins = texts[y - 1] in MEMBER_STARTS or (y < len(toks) and toks[y][2] != toks[y - 1][2])
            if word(y) and begins and texts[y + 1] in ("=", ";", "?", "!", ":", "}"):
                roles.setdefault(y, "TypeField")


def _roles(toks: list, texts: list[str], match: dict[int, int], language: str) -> dict[int, str]:
    """What names are, by the tokens around them."""
    n = len(toks)
    roles: dict[int, str] = {}

    def text(i: int) -> str:
        return toks[i][1] if 0 <= i < n else ""

    def word(i: int) -> bool:
        return 0 <= i < n and toks[i][0] == "word" and toks[i][1] not in KEYWORDS - TYPE_WORDS

    script = language in ("typescript", "javascript")
    beans = language in ("java", "csharp")
    imported = 0  # the end of the import that was met last
    for i in range(n):
        t = texts[i]
        if script:
            if t == "import" and texts[i + 1] not in ("(", "."):
                imported = i
                while imported < n and toks[imported][0] != "str" and texts[imported] != ";":
                    imported += 1
            elif t == "{" and i > imported and texts[i - 1] in BEFORE_OBJECT:
                for x in _level(texts, match, i):
                    if word(x) and texts[x - 1] in ("{", ",") and texts[x + 1] in (",", "}"):
                        roles.setdefault(x, "Destructure")
            elif t == "class" and texts[i - 1] not in (".", "?."):
                _class_fields(toks, texts, match, i, word, roles)
            if t in ("const", "let", "var"):
                if text(i + 1) in "{[" and text(i + 1):
                    for x in range(i + 2, match.get(i + 1, i + 1)):
                        if word(x) and text(x + 1) != ":" and text(x - 1) in ("{", ",", "...", "[", ":"):
                            roles[x] = "Destructure"
                elif word(i + 1):
                    roles[i + 1] = "VariableDecl"
            elif t == "(" and i in match:
                close = match[i]
                head = text(close + 1) == "=>" or text(i - 1) == "function" or text(i - 2) == "function" or text(close + 1) == "{" and text(i - 1) not in ("if", "for", "while", "switch", "catch", "with")
                typed = text(close + 1) == ":" and (text(i - 1) == "constructor" or word(i - 1))
                if head or typed:
                    if word(i - 1) and text(i - 2) not in (".", "?.", "new"):
                        roles[i - 1] = roles.get(i - 1) or "Method"
                    depth = 0
                    for x in range(i + 1, min(close, n)):
                        depth += (text(x) in ("(", "[", "<")) - (text(x) in (")", "]", ">"))
                        if depth <= 0 and word(x) and text(x - 1) in ("(", ",", "{", "...", "private", "public", "protected", "readonly") and text(x + 1) in (",", ")", ":", "?", "=", "}"):
                            roles[x] = "Parameter"
            elif t == ":" and word(i - 1 - (text(i - 1) == "?")) and i - 1 not in roles:
                name = i - 1 - (text(i - 1) == "?")
                if text(name - 1) in ("{", ",", ";", "readonly", "}") or toks[name][2] != (toks[name - 1][2] if name else 0):
                    roles.setdefault(name, "TypeField" if text(i - 1) == "?" else "PropertyDef")
            elif t == "=>" and word(i - 1):
                roles.setdefault(i - 1, "Parameter")
        elif language == "go":
            if t == ":=" or t == "var":
                x = i - 1 if t == ":=" else i + 1
                while word(x):
                    roles[x] = "VariableDecl"
                    x += -2 if t == ":=" else 2
                    if text(x + (1 if t == ":=" else -1)) != ",":
                        break
            elif t == "struct" and text(i + 1) == "{":
                for x in range(i + 2, min(match.get(i + 1, i + 1), n)):
                    if word(x) and toks[x][2] != toks[x - 1][2]:
                        roles[x] = "TypeField"
            elif t == "(" and i in match and (text(i - 1) == "func" or (word(i - 1) and (text(i - 2) == "func" or text(i - 2) == ")"))):
                for x in range(i + 1, min(match[i], n)):
                    if word(x) and text(x - 1) in ("(", ",") and text(x + 1) not in (".", ")"):
                        roles[x] = "Parameter"
                if word(i - 1) and text(i - 1) != "func":
                    roles.setdefault(i - 1, "Method")
            elif t == ":" and word(i - 1) and text(i - 2) in ("{", ","):
                roles[i - 1] = "PropertyDef"
        elif beans and t in ("import", "using", "package") and texts[i - 1] in ("", ";", "}"):
            end = i + 1
            while texts[end] in (".", "=", "*", "static") or word(end):
                roles[end] = "Method"  # parts of a module's name are no names of data
                end += 1
            if texts[end] != ";":  # a resource, not an import
                for x in range(i + 1, end):
                    roles.pop(x)
        elif beans and i in roles:
            continue
        elif language in ("java", "csharp") and word(i) and i and text(i + 1) in ("=", ";", ",", ")", ":", "{", "in", "(") or language in ("java", "csharp") and word(i) and text(i + 1) == "=>":
            before = text(i - 1)
            typed = (word(i - 1) or before in TYPE_WORDS or before in (">", "]", "?")) and text(i - 2) not in (".", "new", "return") and before not in ("return", "new", "throw")
            if typed and text(i + 1) == "(":
                roles[i] = "Method"
            elif typed and text(i + 1) in ("=", ";", ",", ")", ":", "{", "in", "=>"):
                roles[i] = "Parameter" if text(i + 1) in (",", ")") else "VariableDecl"
    return roles


def _unquote(t: str) -> str:
    return t.strip("\"'`")


def _script_modules(toks: list, match: dict[int, int], f: Facts) -> None:
    n = len(toks)

    def text(i: int) -> str:
        return toks[i][1] if 0 <= i < n else ""

    def specs(a: int, b: int) -> list[tuple[str, str]]:
        """(name, alias) pairs between braces."""
        out, x = [], a
        while x < b:
            if toks[x][0] == "word" and not (text(x) == "type" and x + 1 < n and toks[x + 1][0] == "word" and text(x + 1) != "as"):
                alias = text(x + 2) if text(x + 1) == "as" else text(x)
                out.append((text(x), alias))
                x += 3 if text(x + 1) == "as" else 1
            else:
                x += 1
        return out

    def ends(x: int) -> bool:
        """Whether an import without its source ends before a token: a semicolon, the word of another statement, or a word that a line break parts from a word."""
        if toks[x][0] != "word":
            return text(x) not in IMPORT_OPS
        if text(x) in OTHER_STATEMENTS:
            return True
        return toks[x][2] != toks[x - 1][2] and text(x) != "from" and (toks[x - 1][0] == "word" or text(x - 1) == ")") and text(x - 1) not in IMPORT_WORDS

    for i in range(n):
        line = toks[i][2]
        if text(i) == "import" and text(i + 1) not in ("(", "."):
            x, found = i + 1, []
            while x < n and toks[x][0] != "str" and not ends(x):
                if text(x) == "{":
                    found += [("named", alias, name) for name, alias in specs(x + 1, match.get(x, x))]
                    x = match.get(x, x)
                elif text(x) == "*" and text(x + 1) == "as":
                    found.append(("namespace", text(x + 2), "*"))
                    x += 2
                elif toks[x][0] == "word" and text(x) not in ("from", "type"):
                    found.append(("default", text(x), "default"))
                x += 1
            if x < n and toks[x][0] == "str" and text(x - 1) in ("import", "from", "("):
                f.imported(_unquote(text(x)), line, found)
        elif text(i) == "export":
            x = i + 1
            if text(x) == "default":
                f.exported("default", "default", line)
                continue
            if text(x) == "{":
                end = match.get(x, x)
                source = _unquote(text(end + 2)) if text(end + 1) == "from" else None
                for _, alias in specs(x + 1, end):
                    f.exported(alias, "re_export" if source else "named", line, source)
                continue
            while text(x) in ("async", "declare", "abstract"):
                x += 1
            if text(x) in ("function", "class"):
                x += 1 + (text(x + 1) == "*")
                f.exported(text(x), "named", line)
            elif text(x) in ("const", "let", "var") and x + 1 < n and toks[x + 1][0] == "word" and text(x + 1) != "enum":
                f.exported(text(x + 1), "named", line)


def _go_modules(toks: list, match: dict[int, int], f: Facts) -> None:
    n = len(toks)
    depth = 0
    for i, (k, t, ln, _) in enumerate(toks):
        depth += (t in ("{", "(", "[")) - (t in ("}", ")", "]")) if k == "op" else 0
        if k == "word" and t == "import" and i + 1 < n:
            end = match.get(i + 1, i + 2) if toks[i + 1][1] == "(" else i + 3
            for x in range(i + 1, min(end, n)):
                if toks[x][0] == "str":
                    path = _unquote(toks[x][1])
                    alias = toks[x - 1][1] if toks[x - 1][0] == "word" and toks[x - 1][1] != "import" else path.rsplit("/", 1)[-1]
                    f.imported(path, toks[x][2], [("namespace", alias, "*")])
        elif depth == 0 and k == "word" and t in ("func", "type", "var", "const") and i + 1 < n:
            x = i + 1
            if toks[x][1] == "(" and t == "func":
                x = match.get(x, x) + 1
            if x < n and toks[x][1][:1].isupper():
                f.exported(toks[x][1], "named", ln)


def _class_modules(source: str, toks: list, match: dict[int, int], f: Facts, language: str) -> None:
    word = "import" if language == "java" else "using"
    for m in re.finditer(rf"(?m)^[ \t]*{word}[ \t]+(?:static[ \t]+)?(?:(\w+)[ \t]*=[ \t]*)?([\w.]+(?:\.\*)?)[ \t]*;", source):
        f.imported(m[2], source.count("\n", 0, m.start()) + 1, [("namespace", m[1] or m[2].rsplit(".", 1)[-1], "*")])
    depth = 0
    for i, (k, t, ln, _) in enumerate(toks):
        if k == "op":
            depth += (t == "{") - (t == "}")
        if k == "word" and t in ("class", "interface", "enum", "record", "struct") and depth <= (1 if language == "csharp" else 0) and i + 1 < len(toks):
            name = toks[i + 1][1]
            public = any(toks[x][1] == "public" for x in range(max(0, i - 4), i))
            if public or name[:1].isupper():
                f.exported(name, "named", ln)
