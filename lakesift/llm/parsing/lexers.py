"""Token streams for the grammars: one master pattern per language, plus what patterns cannot express (templates, markup, inserted semicolons)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lakesift.llm.parsing.lr import Tables

#: (terminal numbers the token may stand for, place in the text, whether a line break stands before it)
Token = tuple[tuple[int, ...], int, bool]


class LexError(Exception):
    """A place where no token begins or a token does not end."""

    def __init__(self, at: int, what: str) -> None:
        super().__init__(what)
        self.at = at
        self.what = what


_WORD = r"[^\W\d][\w]*"


def _ops(text: str) -> str:
    return "|".join(re.escape(o) for o in sorted(text.split(), key=len, reverse=True))


_JS_OPS = _ops("{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ?. ? : = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= => . ... @").replace(r"\?\.", r"\?\.(?!\d)")  # before a digit it is a question mark and a number
_GO_OPS = _ops("+ & += &= && == != ( ) - | -= |= || < <= [ ] * ^ *= ^= <- > >= { } / << /= <<= ++ = := , ; % >> %= >>= -- ! ... . : &^ &^= ~")
_JAVA_OPS = _ops("( ) { } [ ] ; , . ... @ :: = > < ! ~ ? : -> == <= >= != && || ++ -- + - * / & | ^ % << += -= *= /= &= |= ^= %= <<=")
_CS_OPS = _ops("{ } [ ] ( ) . .. , : :: ; + - * / % & | ^ ! ~ = < > ? ?? ??= ++ -- && || -> == != <= >= += -= *= /= %= &= |= ^= << <<= =>")


@dataclass
class Language:
    """How the text of a language is cut."""

    pattern: re.Pattern
    keywords: frozenset[str]


def _language(comments: str, strings: str, numbers: str, ops: str, words: str, keywords: list[str]) -> Language:
    # A number must not run into a word; a string that is not closed matches only its opening mark.
    pattern = rf"(?P<space>[^\S\n]+)|(?P<nl>\n)|(?P<comment>{comments})|{strings}|(?P<num>(?:{numbers})(?!\w))|(?P<word>{words})|(?P<op>{ops})"
    return Language(re.compile(pattern, re.S), frozenset(keywords))


def languages() -> dict[str, Language]:
    """All languages by name."""
    from lakesift.llm.parsing import grammars as g

    c_comment = r"//[^\n]*|/\*.*?\*/"
    plain = r'(?P<str>"(?:[^"\\\n]|\\.)*")'
    single = r"(?P<str2>'(?:[^'\\\n]|\\.)*')"
    js_num = r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?"
    go_num = r"0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?i?"
    java_num = r"0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?"
    cs_num = r"0[xX][0-9a-fA-F_]+[uUlL]{0,2}|0[bB][01_]+[uUlL]{0,2}|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[uUlLfFdDmM]{0,2}"
    js_word = r"[^\W\d][\w$]*|\$[\w$]*|(?P<private>\#[^\W\d][\w$]*)"
    java_text = r'(?P<text>"""[^\S\n]*\n(?:[^"\\]|\\.|"(?!""))*""")'
    java_char = r"(?P<char>'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)')"
    cs_char = r"(?P<char>'(?:[^'\\\n]|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{1,4}|\\U[0-9a-fA-F]{8}|\\.)')"
    cs_special = r'(?P<interp>\$+@?"|@\$+")|(?P<raw>"{3,})|(?P<str2>@"(?:[^"]|"")*")'
    go_char = r"(?P<char>'(?:[^'\\\n]|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{3}|\\.)')"
    js = rf"(?P<tick>`)|{plain}|{single}"
    cs_comment = c_comment + r"|(?m:^[^\S\n]*\#[^\n]*)"
    return {
        "javascript": _language(c_comment, js, js_num, _JS_OPS, js_word, g.JS_RESERVED),
        "typescript": _language(c_comment, js, js_num, _JS_OPS, js_word, g.JS_RESERVED),
        "go": _language(c_comment, rf"(?P<str2>`[^`]*`)|{plain}|{go_char}", go_num, _GO_OPS, _WORD, g.GO_KEYWORDS),
        "java": _language(c_comment, rf"{java_text}|{plain}|{java_char}", java_num, _JAVA_OPS, r"[^\W\d][\w$]*|\$[\w$]*", g.JAVA_KEYWORDS),
        "csharp": _language(cs_comment, rf"{cs_special}|{plain}|{cs_char}", cs_num, _CS_OPS, r"@?[^\W\d]\w*", g.CSHARP_KEYWORDS),
    }


class Lexer:
    """Cuts texts of one language into the terminals of its tables."""

    def __init__(self, name: str, language: Language, tables: Tables) -> None:
        self.name = name
        self.match = language.pattern.match
        self.script = name in ("javascript", "typescript")
        term = tables.terminals
        self.term = term
        self.names = (term["NAME"],)
        kinds: dict[str, tuple[int, ...]] = {}
        for t, n in term.items():
            if t.startswith("'"):
                w = t[1:-1]
                if w[:1].isalpha() or w == "_":
                    kinds[w] = (n, *self.names) if w in tables.contextual else (n,)
                else:
                    kinds[w] = (n,)
        for w in language.keywords:
            kinds.setdefault(w, (-1,))
        self.kinds = kinds
        self.keywords = language.keywords
        self.fixed = {k: (term[t],) for k, t in (("num", "NUM"), ("str", "STR"), ("str2", "STR"), ("text", "STR"), ("char", "CHAR"), ("private", "PRIVATE")) if t in term}
        self.semicolon = kinds[";"]
        self.end = (0,)
        # Words after which a slash begins a regular expression and a line break ends a statement.
        self.before_value = {w for w in self.keywords if w not in ("this", "super", "null", "true", "false")}

    def tokens(self, text: str) -> list[Token]:
        """The whole token stream, ending with the end mark."""
        out: list[Token] = []
        start = 0
        if text.startswith("﻿"):
            start = 1
        if self.script and text.startswith("#!", start):
            start = text.find("\n", start)
            start = len(text) if start < 0 else start
        end = self._run(text, start, out, nested=False)
        if self.name == "go" and out and self.last == "value":
            out.append((self.semicolon, end, True))
        out.append((self.end, end, True))
        return out

    def _run(self, text: str, at: int, out: list[Token], nested: bool) -> int:
        """Tokens from ``at`` on; nested runs end at the brace that closes a template's part. Returns where it ended."""
        match, kinds, fixed, names = self.match, self.kinds, self.fixed, self.names
        size, fresh, depth = len(text), False, 0
        go, sharp = self.name == "go", self.name == "csharp"
        self.last = "start"
        previous = ""
        while at < size:
            m = match(text, at)
            if m is None:
                raise LexError(at, "no token begins here")
            kind = m.lastgroup
            stop = m.end()
            if kind == "space":
                at = stop
                continue
            if kind == "nl" or kind == "comment":
                if kind == "nl" or "\n" in m.group():
                    if go and self.last == "value":
                        out.append((self.semicolon, at, True))
                        self.last = "op"
                    elif self.script and previous in ("return", "break", "continue") and not fresh:
                        out.append((self.semicolon, at, True))
                        self.last = "op"
                    fresh = True
                at = stop
                continue
            if kind == "word" or kind == "private":
                w = m.group()
                if kind == "private":
                    out.append((fixed["private"], at, fresh))
                    self.last = "value"
                elif previous in (".", "?.") and self.script:
                    out.append((names, at, fresh))
                    self.last = "value"
                else:
                    k = kinds.get(w)
                    if k is None or not (w[:1].isalpha() or w == "_"):
                        out.append((names, at, fresh))
                        self.last = "value"
                    else:
                        out.append((k, at, fresh))
                        keyword = w in self.keywords
                        if go:
                            self.last = "value" if not keyword or w in ("break", "continue", "fallthrough", "return") else "op"
                        else:
                            self.last = "op" if keyword and w in self.before_value else "value"
                previous = w
            elif kind == "op":
                o = m.group()
                if self.script and o in ("/", "/=") and self.last != "value":
                    stop = self._regex(text, at)
                    out.append(((self.term["REGEX"],), at, fresh))
                    self.last = "value"
                elif self.script and o == "<" and self.last != "value" and (stop < size and (text[stop].isalpha() or text[stop] == ">")) and (after := self._markup(text, at, out, fresh)):
                    stop = after
                    self.last = "value"
                else:
                    if nested:
                        if o == "{" or sharp and o in ("(", "["):
                            depth += 1
                        elif o == "}" and not depth:
                            return at
                        elif o == "}" or sharp and o in (")", "]"):
                            depth -= 1
                        elif sharp and o == ":" and not depth:  # the rest of the part is a format
                            stop = text.find("}", at)
                            if stop < 0:
                                raise LexError(at, "a string does not end")
                            return stop
                    if self.script and fresh and o in ("++", "--") and self.last == "value":
                        out.append((self.semicolon, at, True))  # these never follow what they change across a line break
                    k = kinds.get(o)
                    if k is None:
                        raise LexError(at, f"{o} is no operator here")
                    out.append((k, at, fresh))
                    self.last = "value" if o in (")", "]", "}") or (go and o in ("++", "--")) else "op"
                previous = o
            elif kind == "tick":
                stop = self._template(text, at, out, fresh)
                self.last = "value"
                previous = "`"
            elif kind in ("interp", "raw"):
                stop = self._sharp_string(text, at, m.group(), out, fresh)
                self.last = "value"
                previous = '"'
            else:
                out.append((fixed[kind], at, fresh))
                self.last = "value"
                previous = kind
            at = stop
            fresh = False
        if nested:
            raise LexError(size, "a template does not end")
        return at

    def _template(self, text: str, at: int, out: list[Token], fresh: bool) -> int:
        """A template with its parts; returns the place after it."""
        term, i, size, head = self.term, at + 1, len(text), True
        while True:
            while i < size and text[i] != "`" and not text.startswith("${", i):
                i += 2 if text[i] == "\\" else 1
            if i >= size:
                raise LexError(at, "a template does not end")
            if text[i] == "`":
                out.append(((term["TEMPLATE" if head else "T_TAIL"],), at, fresh))
                return i + 1
            out.append(((term["T_HEAD" if head else "T_MIDDLE"],), at, fresh))
            head = False
            i = self._run(text, i + 2, out, nested=True) + 1

    _CLASS = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[\w$]*")

    def _regex(self, text: str, at: int) -> int:
        m = self._CLASS.match(text, at)
        if not m:
            raise LexError(at, "a regular expression does not end")
        return m.end()

    _TAG = re.compile(r"<\s*([A-Za-z][\w.:-]*)?")

    def _markup(self, text: str, at: int, out: list[Token], fresh: bool) -> int:
        """The place after a markup element that begins here, its tokens being added, or 0 if none does."""
        holes: list[tuple[list[Token], int]] = []
        wrong: list[int] = []
        stop = self._element(text, at, holes, wrong)
        if stop:
            if wrong:
                raise LexError(wrong[0], "no value for an attribute here")
            self._parted("J_HEAD", "J_MIDDLE", "J_TAIL", "JSX", at, fresh, [h for h in holes if h[0]], out)
        return stop

    def _parted(self, head: str, middle: str, tail: str, whole: str, at: int, fresh: bool, holes: list[tuple[list[Token], int]], out: list[Token]) -> None:
        """Terminals of a text with parts of code in it, each part given by its tokens and its end."""
        term = self.term
        out.append(((term[head if holes else whole],), at, fresh))
        for n, (tokens, end) in enumerate(holes, 1):
            out += tokens
            out.append(((term[middle if n < len(holes) else tail],), end, False))

    def _element(self, text: str, at: int, holes: list[tuple[list[Token], int]], wrong: list[int]) -> int:
        i, size, open_tags = at, len(text), []
        while i < size:
            if text.startswith("</", i):
                stop = text.find(">", i)
                if stop < 0 or not open_tags or text[i + 2 : stop].strip() != open_tags.pop():
                    return 0
                i = stop + 1
                if not open_tags:
                    return i
            elif text[i] == "<":
                m = self._TAG.match(text, i)
                name = m[1] or ""
                i = m.end()
                while i < size and text[i] != ">" and not text.startswith("/>", i):
                    c = text[i]
                    if c == "{":
                        start = before = i
                        while text[before - 1].isspace():
                            before -= 1
                        value = text[before - 1] == "="
                        i = self._braced(text, i, holes)
                        tokens = holes[-1][0]
                        if not tokens or (tokens[0][0] == self.kinds["..."]) == value:  # a value is an expression, a part without a name is spread
                            wrong.append(start)
                    elif c in "\"'":
                        i = text.find(c, i + 1) + 1
                        if not i:
                            return 0
                    elif c.isspace() or c.isalnum() or c in "-_:.=":
                        i += 1
                    else:
                        return 0
                if i >= size:
                    return 0
                if text[i] == "/":
                    i += 2
                    if not open_tags:
                        return i
                else:
                    i += 1
                    open_tags.append(name)
            elif text[i] == "{" and open_tags:
                i = self._braced(text, i, holes)
            elif open_tags:
                i += 1
            else:
                return 0
        return 0

    def _braced(self, text: str, at: int, holes: list[tuple[list[Token], int]]) -> int:
        """The place after a part in braces; its tokens and end are added to ``holes``."""
        saved, tokens = self.last, []
        try:
            end = self._run(text, at + 1, tokens, nested=True)
        finally:
            self.last = saved
        holes.append((tokens, end))
        return end + 1

    def _sharp_string(self, text: str, at: int, opening: str, out: list[Token], fresh: bool) -> int:
        """The place after an interpolated or raw string, its tokens being added."""
        holes: list[tuple[list[Token], int]] = []
        if opening.startswith('"'):
            stop = text.find(opening, at + len(opening))
            if stop < 0:
                raise LexError(at, "a raw string does not end")
            stop += len(opening)
            while stop < len(text) and text[stop] == '"':
                stop += 1
            out.append((self.fixed["str"], at, fresh))
            return stop
        after = at + len(opening)
        stop = self._raw_parts(text, at, opening, holes) if text.startswith('""', after) and "@" not in opening else self._string_parts(text, at, opening, holes)
        for tokens, end in holes:
            if not tokens:
                raise LexError(end, "a part of a string is empty")
        self._parted("I_HEAD", "I_MIDDLE", "I_TAIL", "STR", at, fresh, holes, out)
        return stop

    _RUN = re.compile(r'"+|\{+|\}+|[^"{}]+')

    def _raw_parts(self, text: str, at: int, opening: str, holes: list[tuple[list[Token], int]]) -> int:
        """The place after an interpolated raw string: as many braces as dollar signs open and close a part."""
        i = at + len(opening) - 1
        n, quotes = opening.count("$"), len(self._RUN.match(text, i)[0])
        i += quotes
        while i < len(text):
            run = self._RUN.match(text, i)[0]
            if run[0] == '"' and len(run) >= quotes:
                return i + len(run)
            if run[0] == "{" and len(run) >= n:
                if len(run) >= 2 * n:
                    raise LexError(i, "too many braces")
                i = self._braced(text, i + len(run) - 1, holes)
                if not text.startswith("}" * (n - 1), i):
                    raise LexError(i, "a part of a string does not end")
                i += n - 1
            else:
                i += len(run)
        raise LexError(at, "a raw string does not end")

    def _string_parts(self, text: str, at: int, opening: str, holes: list[tuple[list[Token], int]]) -> int:
        """The place after an interpolated string."""
        verbatim = "@" in opening
        i, size = at + len(opening), len(text)
        while i < size:
            c = text[i]
            if c == '"':
                if verbatim and text.startswith('""', i):
                    i += 2
                    continue
                return i + 1
            if c == "\n" and not verbatim:
                break
            if c == "\\" and not verbatim:
                i += 2
            elif text.startswith("{{", i) or text.startswith("}}", i):
                i += 2
            elif c == "{":
                i = self._braced(text, i, holes)
            else:
                i += 1
        raise LexError(at, "a string does not end")
