"""Python: its grammar in the notation of ``lr`` and a lexer with line ends, indentation and the parts of formatted strings.

The grammar is that of Python 3.13, fixed by this file whatever interpreter runs it. What the language decides after parsing (names declared twice, a
``return`` outside a function) is no fault here.
"""

from __future__ import annotations

import re

from lakesift.llm.parsing.lexers import LexError, Token
from lakesift.llm.parsing.lr import Tables

KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise "
    "return try while with yield"
).split()
CONTEXTUAL = {"match", "case", "type"}
GRAMMAR = """
File : (NEWLINE | Stmt)* ;
Stmt : Line | If | While | For | Try | With | Def | Class | Match ;
Line : (Small % ';') ';'? NEWLINE ;
Block : Line | NEWLINE INDENT Stmt+ DEDENT ;
Small : StarExprs | Yield | Assign | 'pass' | 'break' | 'continue' | 'return' StarExprs? | 'raise' (Expr ('from' Expr)?)? | ('global' | 'nonlocal') (NAME % ',')
  | 'del' (Target % ',') ','? | 'assert' Expr (',' Expr)? | Import | 'type' NAME TypeParams? '=' Expr ;
Assign : (StarTargets '=')+ Value | Single ':' Expr ('=' Value)? | Single AugOp Value ;
Value : Yield | StarExprs ;
AugOp : '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
Single : Place | '(' Single ')' ;
Place : NAME | Primary '.' NAME | Primary '[' Slices ']' ;
Target : Place | '(' Target ')' | '(' (Target ',' ((Target % ',') ','?)?)? ')' | '[' ((Target % ',') ','?)? ']' ;
StarTarget : '*' StarAtom | StarAtom ;
StarAtom : Place | '(' StarAtom ')' | '(' (StarTarget ',' ((StarTarget % ',') ','?)?)? ')' | '[' ((StarTarget % ',') ','?)? ']' ;
StarTargets : (StarTarget % ',') ','? ;
Import : 'import' (Module % ',') | 'from' (Dots? Dotted | Dots) 'import' ('*' | (Imported % ',') | '(' (Imported % ',') ','? ')') ;
Module : Dotted ('as' NAME)? ;
Imported : NAME ('as' NAME)? ;
Dots : ('.' | '...')+ ;
Dotted : NAME % '.' ;
If : 'if' Named ':' Block ('elif' Named ':' Block)* Else? ;
Else : 'else' ':' Block ;
While : 'while' Named ':' Block Else? ;
For : 'async'? 'for' StarTargets 'in' StarExprs ':' Block Else? ;
Try : 'try' ':' Block (Finally | Except+ Else? Finally? | ExceptStar+ Else? Finally?) ;
Except : 'except' (Expr ('as' NAME)?)? ':' Block ;
ExceptStar : 'except' '*' Expr ('as' NAME)? ':' Block ;
Finally : 'finally' ':' Block ;
With : 'async'? 'with' ((WithItem % ',') | '(' (WithItem % ',') ','? ')') ':' Block ;
WithItem : Expr ('as' StarTarget)? ;
Decorators : ('@' Named NEWLINE)+ ;
Def : Decorators? 'async'? 'def' NAME TypeParams? '(' Params? ')' ('->' Expr)? ':' Block ;
Class : Decorators? 'class' NAME TypeParams? ('(' Args? ')')? ':' Block ;
TypeParams : '[' (TypeParam % ',') ','? ']' ;
TypeParam : NAME (':' Expr)? ('=' Expr)? | '*' NAME ('=' StarExpr)? | '**' NAME ('=' Expr)? ;
Params : Ordered (',' Rest)? ','? | Rest ','? ;
Ordered : Plain | Plains ',' Defaults | Defaults | Plains ',' '/' (',' Ordered0)? | (Plains ',')? Defaults ',' '/' (',' Defaults)? ;
Ordered0 : Plains | Plains ',' Defaults | Defaults ;
Plains : Param % ',' ;
Plain : Plains ;
Defaults : (Param '=' Expr) % ',' ;
Param : NAME (':' Expr)? ;
Rest : '*' NAME (':' StarExpr)? (',' Keyword)* (',' '**' Param)? | '*' (',' Keyword)+ (',' '**' Param)? | '**' Param ;
Keyword : Param ('=' Expr)? ;
LambdaParams : LOrdered (',' LRest)? ','? | LRest ','? ;
LOrdered : LPlains | LPlains ',' LDefaults | LDefaults | LPlains ',' '/' (',' LOrdered0)? | (LPlains ',')? LDefaults ',' '/' (',' LDefaults)? ;
LOrdered0 : LPlains | LPlains ',' LDefaults | LDefaults ;
LPlains : NAME % ',' ;
LDefaults : (NAME '=' Expr) % ',' ;
LRest : '*' NAME (',' LKeyword)* (',' '**' NAME)? | '*' (',' LKeyword)+ (',' '**' NAME)? | '**' NAME ;
LKeyword : NAME ('=' Expr)? ;
Match : 'match' Subject ':' NEWLINE INDENT Case+ DEDENT ;
Subject : StarNamed ',' StarNameds? | Named ;
Case : 'case' (Pattern | Open) ('if' Named)? ':' Block ;
Open : SeqItem ',' ((SeqItem % ',') ','?)? ;
SeqItem : '*' NAME | Pattern ;
Pattern : (Closed % '|') ('as' NAME)? ;
Closed : '-'? NUM | '-'? NUM ('+' | '-') NUM | Strings | 'None' | 'True' | 'False' | Dotted | '(' Pattern ')' | '(' Open? ')' | '[' ((SeqItem % ',') ','?)? ']'
  | '{' ((MapItem % ',') ','?)? '}' | Dotted '(' (ClassItems ','?)? ')' ;
MapItem : ('-'? NUM | '-'? NUM ('+' | '-') NUM | Strings | 'None' | 'True' | 'False' | NAME ('.' NAME)+) ':' Pattern | '**' NAME ;
ClassItems : Pattern % ',' | (NAME '=' Pattern) % ',' | (Pattern % ',') ',' ((NAME '=' Pattern) % ',') ;
StarExprs : (StarExpr % ',') ','? ;
StarExpr : '*' Binary | Expr ;
StarNameds : (StarNamed % ',') ','? ;
StarNamed : '*' Binary | Named ;
Named : NAME ':=' Expr | Expr ;
Yield : 'yield' 'from' Expr | 'yield' StarExprs? ;
Expr : Disjunction | Disjunction 'if' Disjunction 'else' Expr | 'lambda' LambdaParams? ':' Expr ;
Disjunction : Conjunction % 'or' ;
Conjunction : Inversion % 'and' ;
Inversion : 'not' Inversion | Comparison ;
Comparison : Binary | Comparison CompareOp Binary ;
CompareOp : '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
Binary : Unary | Binary BinaryOp Unary ;
BinaryOp : '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' ;
Unary : ('+' | '-' | '~') Unary | Power ;
Power : Awaited | Awaited '**' Unary ;
Awaited : Primary | 'await' Primary ;
Primary : Atom | Primary '.' NAME | Primary '(' Args? ')' | Primary '(' Named ForIn+ ')' | Primary '[' Slices ']' ;
Slices : (Slice % ',') ','? ;
Slice : Named | '*' Binary | Expr? ':' Expr? (':' Expr?)? ;
Args : ArgList ','? ;
ArgList : Positional % ',' | (Positional % ',') ',' Keywords | Keywords ;
Positional : '*' Expr | Named ;
Keywords : KwOrStar % ',' | (KwOrStar % ',') ',' (KwOrStars % ',') | KwOrStars % ',' ;
KwOrStar : NAME '=' Expr | '*' Expr ;
KwOrStars : NAME '=' Expr | '**' Expr ;
ForIn : 'async'? 'for' StarTargets 'in' Disjunction ('if' Disjunction)* ;
Atom : NAME | NUM | Strings | 'True' | 'False' | 'None' | '...' | '(' ')' | '(' Named ')' | '(' Yield ')' | '(' StarNamed ',' StarNameds? ')' | '(' Named ForIn+ ')'
  | '[' StarNameds? ']' | '[' Named ForIn+ ']' | '{' ((Pair % ',') ','?)? '}' | '{' Expr ':' Expr ForIn+ '}' | '{' StarNameds '}' | '{' Named ForIn+ '}' ;
Pair : Expr ':' Expr | '**' Binary ;
Strings : (STR | Formatted)+ | BYTES+ ;
Formatted : F_HEAD Value (F_MIDDLE Value)* F_TAIL ;
"""

_PREFIX = r"[rRuUbB]|[bB][rR]|[rR][bB]"
_NUMBER = (
    r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
)
_OPS = "|".join(
    re.escape(o)
    for o in sorted("( ) [ ] { } , : . ; = + - * / // % @ & | ^ ~ < > << >> ** == != <= >= -> := ... += -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(), key=len, reverse=True)
)
_TOKEN = re.compile(
    r"(?P<space>[ \t\f]+)|(?P<comment>#[^\n]*)|(?P<nl>\n)|(?P<join>\\\n)"
    rf"|(?P<long>(?:{_PREFIX})?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''))"
    r"|(?P<format>(?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|\"|'))"
    rf"|(?P<str>(?:{_PREFIX})?(?:\"(?!\"\")(?:[^\\\"\n]|\\.)*\"|'(?!'')(?:[^\\'\n]|\\.)*'|\"\"(?!\")|''(?!')))"
    rf"|(?P<num>(?:{_NUMBER})(?=(?:and|else|for|if|in|is|not|or)\b|[^\w]|\Z))|(?P<word>(?:[A-Za-z_]|[^\x00-\x7f])(?:\w|[^\x00-\x7f])*)|(?P<op>{_OPS})",
    re.S,
)
_ESCAPES = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N(?!\{[^}]+\})|(?P<fine>.))", re.S)
_BYTE_ESCAPES = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|(?P<fine>.))", re.S)
_CONVERSION = re.compile(r"!\s*[rsa]\s*(?=[:}])")
_SHOWN = re.compile(r"=\s*(?=[!:}])")
#: As many brackets and indents as the language's own parser allows.
MAX_BRACKETS, MAX_INDENTS = 200, 100


def _bad_escape(body: str, pattern: re.Pattern) -> bool:
    return "\\" in body and any(m["fine"] is None for m in pattern.finditer(body))


class PythonLexer:
    """Cuts Python texts into the terminals of its tables."""

    script = False

    def __init__(self, tables: Tables) -> None:
        term = tables.terminals
        self.fixed = {t: (term[t],) for t in ("NAME", "NUM", "STR", "BYTES", "F_HEAD", "F_MIDDLE", "F_TAIL", "NEWLINE", "INDENT", "DEDENT")}
        self.kinds = {t[1:-1]: (n, term["NAME"]) if t[1:-1] in tables.contextual else (n,) for t, n in term.items() if t[0] == "'"}

    def tokens(self, text: str) -> list[Token]:
        """The whole token stream, ending with the end mark."""
        if "\0" in text:
            raise LexError(text.index("\0"), "a null character")
        out: list[Token] = []
        end = self._run(text, 1 if text.startswith("\ufeff") else 0, out, None)
        out.append(((0,), end, True))
        return out

    def _run(self, text: str, at: int, out: list[Token], closing: str | None) -> int:
        """Tokens from ``at`` on: of a file, or of a part of a formatted string up to its brace, format or conversion (``closing`` set)."""
        fixed, kinds, match, size = self.fixed, self.kinds, _TOKEN.match, len(text)
        name, newline = fixed["NAME"], fixed["NEWLINE"]
        indents, brackets, begins = [(0, 0)], [], closing is None
        while at < size:
            if begins:
                at = self._indent(text, at, indents, out)
                begins = False
                continue
            m = match(text, at)
            if m is None:
                if closing and not brackets and text[at] == "!":
                    return at
                raise LexError(at, "no token begins here")
            kind, stop = m.lastgroup, m.end()
            if kind == "word":
                w = m.group()
                k = kinds.get(w)
                if k is None:
                    if not w.isascii() and not w.isidentifier():
                        raise LexError(at, "not a name")
                    k = name
                out.append((k, at, False))
            elif kind == "op":
                o = m.group()
                if o in "([{":
                    brackets.append(o)
                    if len(brackets) > MAX_BRACKETS:
                        raise LexError(at, "too many nested brackets")
                elif o in ")]}":
                    if not brackets:
                        if closing and o == "}":
                            return at
                        raise LexError(at, f"unmatched {o}")
                    if brackets.pop() + o not in ("()", "[]", "{}"):
                        raise LexError(at, f"{o} closes another bracket")
                elif closing and not brackets:
                    if o == ":=" or o == ":":
                        return at
                    if o == "=" and _SHOWN.match(text, at):
                        return _SHOWN.match(text, at).end()
                out.append((kinds[o], at, False))
            elif kind == "nl":
                if not brackets and not closing:
                    out.append((newline, at, True))
                    begins = True
            elif kind == "num":
                n = m.group()
                if n[0] == "0" and n.isdecimal() and n.strip("0"):
                    raise LexError(at, "leading zeros in a number")
                out.append((fixed["NUM"], at, False))
            elif kind in ("str", "long"):
                self._string(m.group(), at, out)
            elif kind == "format":
                stop = self._format(text, at, m.group(), out)
            elif kind == "join" and stop >= size:
                raise LexError(at, "unexpected end")
            at = stop
        if closing:
            raise LexError(size, "a string does not end")
        if brackets:
            raise LexError(size, f"{brackets[-1]} is not closed")
        if out and out[-1][0] != newline and out[-1][0] != fixed["DEDENT"]:
            out.append((newline, size, True))
        out += [(fixed["DEDENT"], size, True)] * (len(indents) - 1)
        return size

    _BLANK = re.compile(r"[ \t\f]*(?:#[^\n]*)?(?:\n|\Z)")
    _SPACE = re.compile(r"[ \t\f]*")

    def _indent(self, text: str, at: int, indents: list[tuple[int, int]], out: list[Token]) -> int:
        """Skip blank lines and compare the next line's indentation: tabs go to the next eighth column, and must not decide alone."""
        while at < len(text) and (m := self._BLANK.match(text, at)):
            at = m.end()
        if at >= len(text):
            return at
        space = self._SPACE.match(text, at)[0]
        width = tabless = 0
        for c in space:
            width, tabless = (0, 0) if c == "\f" else (width // 8 * 8 + 8, tabless + 1) if c == "\t" else (width + 1, tabless + 1)
        place = (width, tabless)
        if text.startswith("\\\n", at + len(space)):  # a joined line: its indentation is that of its first part
            pass
        if (width > indents[-1][0]) != (tabless > indents[-1][1]) or (width == indents[-1][0]) != (tabless == indents[-1][1]):
            if width >= indents[-1][0]:
                raise LexError(at, "tabs and spaces are mixed")
        at += len(space)
        if width > indents[-1][0]:
            indents.append(place)
            if len(indents) > MAX_INDENTS:
                raise LexError(at, "too many indents")
            out.append((self.fixed["INDENT"], at, True))
        while width < indents[-1][0]:
            indents.pop()
            out.append((self.fixed["DEDENT"], at, True))
        if width != indents[-1][0]:
            raise LexError(at, "an indentation that no line before has")
        if tabless != indents[-1][1]:
            raise LexError(at, "tabs and spaces are mixed")
        return at

    def _string(self, token: str, at: int, out: list[Token]) -> None:
        start = min(token.index(q) for q in "\"'" if q in token)
        prefix = token[:start].lower()
        if "b" in prefix:
            if not token.isascii():
                raise LexError(at, "bytes hold ASCII only")
            if "r" not in prefix and _bad_escape(token, _BYTE_ESCAPES):
                raise LexError(at, "an escape is cut off")
            out.append((self.fixed["BYTES"], at, False))
        else:
            if "r" not in prefix and _bad_escape(token, _ESCAPES):
                raise LexError(at, "an escape is cut off")
            out.append((self.fixed["STR"], at, False))

    def _format(self, text: str, at: int, opening: str, out: list[Token]) -> int:
        """The place after a formatted string, its parts' tokens being added."""
        quote = opening.lstrip("fFrR")
        holes: list[tuple[list[Token], int]] = []
        i = self._text_part(text, at, at + len(opening), quote, "r" in opening.lower(), holes, nested=False)
        head, middle, tail = self.fixed["F_HEAD"], self.fixed["F_MIDDLE"], self.fixed["F_TAIL"]
        if not holes:
            out.append((self.fixed["STR"], at, False))
            return i
        out.append((head, at, False))
        for n, (tokens, end) in enumerate(holes, 1):
            if not tokens:
                raise LexError(end, "a part of a string is empty")
            out += tokens
            out.append((middle if n < len(holes) else tail, end, False))
        return i

    def _text_part(self, text: str, at: int, i: int, quote: str, raw: bool, holes: list[tuple[list[Token], int]], nested: bool) -> int:
        """Reads text up to the quote (or, ``nested`` in a format, up to the brace); returns the place after the quote, or of the brace."""
        size = len(text)
        while i < size:
            c = text[i]
            if not nested and text.startswith(quote, i):
                return i + len(quote)
            if nested and c == "}":
                return i
            if c == "\n" and len(quote) == 1:
                break
            if c == "\\":
                if not raw:
                    if text.startswith("\\N{", i) and (end := text.find("}", i)) > 0:
                        i = end + 1
                        continue
                    if _bad_escape(text[i : i + 10], _ESCAPES) and _ESCAPES.match(text, i)["fine"] is None:
                        raise LexError(i, "an escape is cut off")
                i += 1 if text[i + 1 : i + 2] in ("{", "}") else 2
            elif c == "{":
                if text.startswith("{{", i) and not nested:
                    i += 2
                    continue
                i = self._hole(text, i, quote, raw, holes)
            elif c == "}":
                if not text.startswith("}}", i):
                    raise LexError(i, "a single brace in a string")
                i += 2
            else:
                i += 1
        raise LexError(at, "a string does not end")

    def _hole(self, text: str, i: int, quote: str, raw: bool, holes: list[tuple[list[Token], int]]) -> int:
        """The place after a part in braces; its tokens, then those of parts in its format, are added to ``holes``."""
        tokens: list[Token] = []
        end = self._run(text, i + 1, tokens, quote)
        holes.append((tokens, end))
        m = _CONVERSION.match(text, end)
        if m:
            end = m.end()
        if text.startswith(":", end):
            end = self._text_part(text, i, end + 1, quote, raw, holes, nested=True)
        if not text.startswith("}", end):
            raise LexError(end, "a part of a string does not end")
        return end + 1
