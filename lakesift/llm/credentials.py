"""Credentials written out in source code and configuration: find and mask them.

A snippet is read lexically: private key blocks first, then string literals (quotes, back quotes, triple quotes, escapes), then the
bare values of configuration lines, markup and command lines. A literal counts if its content is no stand-in and it is assigned
to, compared with or passed to something named like a credential, or if it has the form of an issued key wherever it stands.
Only the credential's own characters are masked: quotes, names, user names, scheme words and escapes around it stay.

Rows without any sign of a credential are dropped inside the JVM (one regular expression), so only a few reach Python,
in Arrow batches. No shuffle but that of ``one_per_key``.

Defined cases: null and empty snippets hold nothing and come out as they are. Two credentials give two rows, the same credential
written twice in a snippet one. Ids stored twice count once. Extra columns are ignored. Very long snippets are read whole; the
patterns have no nested repetition and run in linear time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.operators.inlining import one_per_key
from lakesift.runtime import ship_package

# Words in names that stand for a secret, and words that make a name stand for something else.
SECRET_WORDS = {
    "password", "passwd", "passphrase", "pass", "pwd", "secret", "token", "apikey", "credential", "credentials", "auth", "cookie",
    "sig", "signature", "jwt", "bearer", "pem", "pat",
}
KEY_WORDS = {
    "api", "access", "secret", "signing", "private", "enc", "encryption", "hmac", "account", "deploy", "auth", "shared", "master",
    "service", "storage", "client", "session", "jwt", "license", "ssh", "webhook", "app", "aes", "crypto", "sign",
}
OTHER_WORDS = {
    "url", "uri", "name", "id", "file", "path", "type", "length", "len", "hint", "label", "field", "ttl", "expiry", "expires", "header",
    "prefix", "regex", "pattern", "endpoint", "hash", "digest", "sha256", "sha512", "etag", "integrity", "public", "fingerprint", "policy",
    "min", "max", "count", "limit", "message", "error", "title", "help", "description", "placeholder", "version", "checksum", "env", "ref",
    "arn", "issuer", "audience", "scope", "realm", "host", "region",
}
STAND_INS = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|_+|0+|#+|1234567890?|change[-_]?me.*|replace[-_]?me.*|your[-_ ].*|my[-_](?:secret|password|token|key).*|"
    r"(?:password|passwd|secret|token|todo|tbd|none|null|nil|undefined|true|false|empty|redacted|masked|hidden|example|sample|dummy|"
    r"placeholder|fixme|unset|default|string|str|text)\d*|.*(?:placeholder|change[-_]?me|redacted|example[-_]?(?:key|token|secret|password)).*)$"
)
REFERENCE = re.compile(
    r"^(?:\$\{?[A-Za-z_][\w.:-]*\}?|\{\{.*\}\}|\{[\w.\[\]()]*\}|<.*>|%\(?\w+\)?s?|%[A-Z_]+%|\[.*\]|@.*@|(?:process\.env|os\.environ|env|vault|ssm|arn|op|"
    r"secretsmanager|keyvault|kms|file|ref)[:.(\[].*|https?://.*|data:.*|sha(?:1|256|384|512)-.*)$"
)
WORD_PATH = re.compile(r"^[a-z]+(?:[-_./][a-z]+)+$")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
HEX = re.compile(r"(?i)^[0-9a-f]{16,}$")
JWT = re.compile(r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}")
ISSUED = re.compile(
    r"^(?:[a-z]{2,8}[-_.](?:(?:prod|live|test|dev)[-_.])?[A-Za-z0-9_-]{18,}|[A-Z]{2}[A-Z0-9]{16,20}|[a-z0-9]{8}-[a-z0-9]{12}\.[A-Za-z0-9]{16})$"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
LITERAL = re.compile(
    r'"""(?P<t>(?:[^"\\]|\\.|"(?!""))*)"""|\'\'\'(?P<u>(?:[^\'\\]|\\.|\'(?!\'\'))*)\'\'\'|"(?P<d>(?:[^"\\\n]|\\.)*)"|'
    r"'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>(?:[^`\\]|\\.)*)`",
    re.S,
)
# Comments are cut off first: a quote or tick in one opens no literal beyond it; what is quoted inside counts.
TOKEN = re.compile(r"(?P<comment>//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))|" + LITERAL.pattern, re.S)
USERINFO = re.compile(r"(?<![\w+.-])[A-Za-z][\w+.-]*://[^\s:/@\"'`]*:(?P<v>[^\s@/\"'`]+)@")
PARAM = re.compile(r"[?&](?P<k>[\w.-]+)=(?P<v>[^&#\s\"'`]+)")
PAIR = re.compile(r"(?:^|;)\s*(?P<k>[A-Za-z][\w .-]*?)\s*=\s*(?P<v>[^;\"']+)")
SCHEME = re.compile(r"(?i)\b(?P<k>bearer|basic|token)\s+(?P<v>[A-Za-z0-9+/_.=~-]{8,})")
DEFAULT = re.compile(r"\$\{(?P<k>[\w.-]+):-?(?P<v>[^}]+)\}")
SETTING = re.compile(
    r"(?m)^[ \t]*(?:-[ \t]+)?(?:(?:export|ENV|ARG|set|setx)[ \t]+)?(?P<k>[A-Za-z_][\w.-]*)(?:[ \t]*[=:][ \t]*|[ \t]+(?=\S+[ \t]*$))(?P<v>[^\s\"'`]+)[ \t]*(?:[#;].*)?$"
)
MARKUP = re.compile(r"<(?P<tag>[\w.:-]+)(?P<attrs>[^<>]*)>(?P<v>[^<>\s]+)</")
ATTR = re.compile(r"""([\w.:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
# Command words, options that carry a password, and line ends (a backslash continues the line); read in one forward scan.
COMMAND = re.compile(
    r"""\b(?P<curl>curl)\b|\b(?P<mysql>mysql(?:dump|admin)?)\b|\s(?:-u|--user)[= ]['"]?[^\s:'"]+:(?P<a>[^\s'"]+)|\s(?:-p|--password=)(?P<c>[^\s'"]+)|"""
    r"""\bsshpass\s+-p\s*['"]?(?P<b>[^\s'"]+)|\bPGPASSWORD=(?P<d>[^\s'"]+)|(?P<end>(?<!\\)(?<!\\\r)\n)"""
)
REMARK = re.compile(r"(?://|#|--|/\*|<!--)(?P<text>[^\n]*)")
SAID = re.compile(r"(?i)\b(?:key|token|password|secret|passphrase|credential)s?\b[^\n]{0,12}?\b(?:was|is|were|are|equals|now)\b\s*:?\s*[\"'`]?(?P<v>[^\s,;\"'`]+)")
# What may stand right before a literal that is named: first the end of it, then each word where the whole may begin.
NAMING = re.compile(r"[=>:]\s*[a-zA-Z@$]{0,2}$")
NAME_STARTS = re.compile(r"""["'`]?[A-Za-z_@][\w.$-]*+""")
NAME_BEFORE = re.compile(r"""(?:["'`]?(?P<k>[A-Za-z_@][\w.$-]*+)["'`]?\s*\]?\s*(?::\s*[A-Za-z_][\w<>\[\]| ?.]*)?\s*(?P<op>===?|!==?|:=|=>|\?\?=|=|:)\s*[a-zA-Z@$]{0,2})$""")
HELD_IN = re.compile(r"(?:self|this|req|request|config|conf|settings|env|os|process|body|params|input|args|options|opts|props|ctx|state|user|vault|secrets?)\.")

# Words in the names of calls that open something with a credential.
CALL_WORDS = ("login", "connect", "auth", "credential", "client", "open", "signin", "session", "account", "smtp", "ftp", "bind")
CALL = re.compile("(?i)" + "|".join(CALL_WORDS))
BRACKET = re.compile(r"[()]")
INNER = re.compile(r"""\\(?:u\{[0-9a-fA-F]+\}|u+[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{1,4}|N\{[^}]*\}|[0-7]{1,3})|(?P<kept>\\[abfnrtv\\'"`$\n]|\s)|\\.|.""", re.S)
VALUE_AFTER = re.compile(r"\s+value\s*=")
CLOSED_AFTER = re.compile(r"\s*[)\]]")


def _as_word(w: str) -> str:
    """The forms in which ``words_of`` may read a word out of an identifier."""
    return rf"{w.upper()}(?![a-z])|[{w[0].upper()}{w[0]}]{w[1:]}(?![a-z])"


#: What a row must show, at least, to be looked at in Python: a superset of all rules above and of ``spans``, built from their words. Java
#: and Python agree on it, so classes that differ between them (``\w``, ``\s``) stand only where Java's are the wider.
HINT = (
    r"(?iu)(eyJ|://[^\s:/@\"'`]*:|curl|mysql|bearer|basic|token|password|secret|passphrase|credential|k[^a-z0-9]*e[^a-z0-9]*y|"
    + "|".join(CALL_WORDS)
    + r"|[\"'`][A-Za-z0-9_.-]{18,}[\"'`]|(?-i:"
    + "|".join(_as_word(w) for w in sorted(SECRET_WORDS))
    + "))"
)


def words_of(name: str) -> list[str]:
    """Lower-case words of an identifier in any case style."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+\d*|\d+", name)]


def names_secret(name: str) -> bool:
    """Whether an identifier stands for a secret value."""
    w = words_of(name)
    if not w or w[-1] in OTHER_WORDS or "public" in w:
        return False
    if SECRET_WORDS & set(w):
        return True
    return "key" in w and (bool(KEY_WORDS & set(w)) or name in ("KEY", "key")) or "".join(w).endswith(("apikey", "secretkey"))


def names_key(name: str) -> bool:
    """Whether an identifier ends in "key": enough for a value that looks drawn at random."""
    return words_of(name)[-1:] == ["key"] and "public" not in words_of(name)


def entropy(s: str) -> float:
    """Bits per character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def stands_in(v: str) -> bool:
    """Whether a value is a stand-in, a reference or plain words rather than a secret."""
    return (
        len(v) < 5 or len(set(v)) < 3 or any(c.isspace() for c in v) or bool(STAND_INS.match(v) or REFERENCE.match(v) or WORD_PATH.match(v))
    )


def works(v: str) -> bool:
    """Whether a value could be a password or key as it stands."""
    if stands_in(v):
        return False
    digit, upper, lower = any(c.isdigit() for c in v), any(c.isupper() for c in v), any(c.islower() for c in v)
    sign = any(not c.isalnum() and c not in "._-" for c in v)
    mixed = upper and lower and bool(re.search(r"[a-z][A-Z].*[a-z]|[A-Z]{2}.*[a-z].*[A-Z]|[a-z]{3}[A-Z]{2,}", v))
    return digit or sign or bool(ISSUED.match(v)) or (mixed and entropy(v) > 3.3 and len(v) >= 10)


def drawn(v: str) -> bool:
    """Whether a value looks drawn at random."""
    return len(v) >= 16 and works(v) and any(c.isdigit() for c in v) and entropy(v) > 3.2 and not UUID.match(v)


def issued(v: str) -> bool:
    """Whether a value has the form of an issued key, whatever it is called."""
    if UUID.match(v) or HEX.match(v) or stands_in(v):
        return False
    if JWT.fullmatch(v):
        return True
    m = ISSUED.match(v)
    if not m:
        return False
    body = re.split(r"[-_.]", v)[-1] if not v.isupper() else v
    return any(c.isdigit() for c in body) and any(c.isalpha() for c in body) and entropy(v) > 3.2


def spans(text: str) -> list[tuple[int, int]]:
    """Places of the credentials in a snippet, in order, not overlapping."""
    found: list[tuple[int, int]] = []

    taken = bytearray(len(text))

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    def add(a: int, b: int) -> None:
        if b > a and free(a, b):
            found.append((a, b))
            taken[a:b] = b"\1" * (b - a)

    for m in PEM.finditer(text):
        add(*m.span())
    for m in USERINFO.finditer(text):
        if works(m["v"]) or (not stands_in(m["v"]) and "+" not in m["v"]):
            add(*m.span("v"))
    for m in SCHEME.finditer(text):
        if works(m["v"]):
            add(*m.span("v"))
    for m in JWT.finditer(text):
        add(*m.span())
    for m in PARAM.finditer(text):
        if names_secret(m["k"]) and works(m["v"]):
            add(*m.span("v"))
    for m in DEFAULT.finditer(text):
        if names_secret(m["k"]) and works(m["v"]):
            add(*m.span("v"))
    for a, b in _commands(text):
        if not stands_in(text[a:b]):
            add(a, b)
    literals = list(_read_literals(text))
    quoted = bytearray(len(text))
    for m in literals:
        quoted[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    _literals(text, literals, add, free)
    for m in MARKUP.finditer(text):
        named = [m["tag"], *[a or b for _, a, b in ATTR.findall(m["attrs"])]]
        if any(names_secret(n) for n in named) and works(m["v"]):
            add(*m.span("v"))
    for m in REMARK.finditer(text):
        for s in SAID.finditer(m["text"]):
            v = s["v"].rstrip(".:)")
            if works(v):
                a = m.start("text") + s.start("v")
                add(a, a + len(v))
    for m in SETTING.finditer(text):
        v = m["v"].rstrip(",;")
        inside = quoted[m.start("v")]
        bare = v.isalpha() and not m["k"].isupper()  # an identifier rather than a value
        named = names_secret(m["k"]) and works(v) or names_key(m["k"]) and drawn(v)
        code = re.search(r"[(\[{]", v) or HELD_IN.match(v)
        if not inside and not bare and named and not code:
            a = m.start("v")
            add(a, a + len(v))
    return sorted(found)


def _read_literals(text: str) -> Iterator[re.Match]:
    """The string literals of a snippet in order, in code and in comments."""
    for m in TOKEN.finditer(text):
        if m["comment"] is None:
            yield LITERAL.match(text, m.start())
        else:
            yield from LITERAL.finditer(text, m.start(), m.end())


def _commands(text: str) -> Iterator[tuple[int, int]]:
    """Places of passwords on command lines: one scan that keeps the command words read since the line began."""
    running: set[str] = set()
    at = 0
    while m := COMMAND.search(text, at):
        k, at = m.lastgroup, m.end()
        if k in ("curl", "mysql"):
            running.add(k)
        elif k == "end":
            running.clear()
        elif k in ("b", "d"):
            yield m.span(k)
        elif (command := "curl" if k == "a" else "mysql") in running:
            running.discard(command)
            yield m.span(k)
        else:
            at = m.start() + 1  # an option of something else: only its white space is read


def _short_space(m: re.Match) -> str:
    """White space that patterns treat like ``m``, of one character."""
    s = m[0]
    return s if s == "\n" else "\t" if s.strip(" ") else " "


def _named(before: str) -> re.Match | None:
    """The name before a literal: it stands in the gap before it, or is the literal before that gap. A word is tried once, so long ones cost no more."""
    before = re.sub(r"\s+", _short_space, before)
    return next((m for w in NAME_STARTS.finditer(before) if (m := NAME_BEFORE.match(before, w.start()))), None)


def _open_brackets(text: str, literals: list[re.Match]) -> list[int]:
    """For each literal the place of the innermost round bracket open before it, or -1; brackets in literals do not count."""
    out, stack, at = [], [], 0
    for m in literals:
        for b in BRACKET.finditer(text, at, m.start()):
            if b[0] == "(":
                stack.append(b.start())
            elif stack:
                stack.pop()
        out.append(stack[-1] if stack else -1)
        at = m.end()
    return out


def _opens(text: str, bracket: int) -> bool:
    """Whether the name before a bracket is that of a call that opens something with a credential."""
    end = bracket
    while end and text[end - 1].isspace():
        end -= 1
    while end and text[end - 1] in ":=":
        end -= 1
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        start -= 1
    return bool(CALL.search(text, start, end))


def _literals(text: str, literals: list[re.Match], add, free) -> None:
    """String literals: their name is what they are assigned to, compared with, or passed to."""
    inner = _open_brackets(text, literals)
    opens = cache(lambda bracket: bracket >= 0 and _opens(text, bracket))
    for i, m in enumerate(literals):
        group = m.lastgroup
        a, b = m.span(group)
        v = text[a:b]
        if not free(a, b):
            continue
        gap = text[literals[i - 1].end() if i else 0 : m.start()]
        if ";" in v and "=" in v:  # a connection string
            pairs = [(p["k"], p.span("v"), p["v"]) for p in PAIR.finditer(v)]
            for k, (x, y), pv in pairs:
                if names_secret(k) and works(pv):
                    add(a + x, a + y)
            if pairs:
                continue
        named = _named(text[literals[i - 1].start() if i else 0 : m.start()]) if NAMING.search(gap) else None
        if named:
            compared = named["op"] in ("==", "===", "!=", "!==")
            good = works(v) and (not compared or not v.isalpha())
            name = named["k"].rstrip("]\"'")
            if VALUE_AFTER.match(text, m.end()):
                continue  # the literal is itself the name
            if names_secret(name) and good or names_key(name) and (drawn(v) or ISSUED.match(v) and not stands_in(v)):
                add(a, b)
                continue
        if issued(v) and not (named and set(words_of(named["k"])) & OTHER_WORDS and not names_secret(named["k"])):
            add(a, b)
            continue
        gap = gap.strip()
        if i and gap == "," or re.search(r"\w,\Z", gap[-2:]):
            # an argument or tuple member after others
            first = literals[i - 1]
            key = first[first.lastgroup] if i else ""
            if i and gap == "," and names_secret(key) and re.fullmatch(r"[\w.-]+", key):
                if works(v):
                    add(a, b)
                continue
            call = opens(inner[i])
            last = CLOSED_AFTER.match(text, m.end())
            if call and last and works(v) and not re.search(r"://|@|^\d+$|\.(?:com|example|net|org)\b", v):
                add(a, b)
            continue
        pair = text[literals[i - 2].end() if i > 1 else 0 : m.start()]
        attrs = re.search(r"""(?:key|name)\s*=\s*["']([\w.:-]+)["']\s+value\s*=\s*$""", pair)
        if attrs and names_secret(attrs[1]) and works(v):
            add(a, b)


def masked(text: str | None, mark: str = "*") -> str | None:
    """The snippet with every credential's characters replaced by ``mark``, all else as it was.

    White space, line breaks and plain escapes (``\\n``, ``\\"``) stay; an escape that spells a character of the credential is masked whole, so none is left broken.
    """
    if not text:
        return text
    out, at = [], 0
    for a, b in spans(text):
        out.append(text[at:a])
        out.append(INNER.sub(lambda m: m["kept"] or mark * len(m[0]), text[a:b]))
        at = b
    return "".join(out) + text[at:]


def hinted(snippet: Column) -> Column:
    """Whether a snippet shows any sign of a credential; decided in the JVM."""
    return snippet.rlike(HINT)


def credentials(findings: DataFrame, id_col: str, snippet_col: str) -> DataFrame:
    """(id_col, credential): one row for each credential written out in a snippet; each id counts once."""
    ship_package(findings.sparkSession)
    slim = findings.select(F.col(id_col).alias("id"), F.col(snippet_col).alias("snippet")).where(hinted(F.col(snippet_col)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, creds = [], []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for c in dict.fromkeys(s[a:b] for a, b in spans(s)):
                    ids.append(i)
                    creds.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(creds, pa.string())], ["id", "credential"])

    found = one_per_key(slim, "id").select(F.col("id").cast("string"), "snippet").mapInArrow(read, "id string, credential string")
    return found.withColumnRenamed("id", id_col)


def redact(findings: DataFrame, snippet_col: str, mark: str = "*") -> DataFrame:
    """All rows and columns, with ``<snippet_col>_masked`` added; rows without a sign of a credential never leave the JVM."""
    ship_package(findings.sparkSession)
    name = f"{snippet_col}_masked"

    @F.pandas_udf("string")
    def mask(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: masked(t, mark))

    # Python sees a text only where there is a sign; the rest passes null through the batch.
    sign = F.when(hinted(F.col(snippet_col)), F.col(snippet_col))
    return findings.withColumn(name, F.coalesce(mask(sign), F.col(snippet_col)))
