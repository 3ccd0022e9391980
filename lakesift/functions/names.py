"""Expressions over names and texts: the dictionary, literal patterns, contexts and sinks. All stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache, reduce
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.config import CustomSink, CustomType
from lakesift.rules.dictionary import CONFIDENCE_RANK, DICTIONARY
from lakesift.rules.literals import LITERALS, SAFE_NAMES, TEST_CONTEXT
from lakesift.rules.sinks import DATABASE_ENDS, HTTP_STARTS, LOG_CALLS, LOG_ENDS, RESPONSE_ENDS, RESPONSE_HOLDERS


def dictionary_entries(custom: Sequence[CustomType] = ()) -> list[tuple[int, str, str, str, str, str]]:
    """(number, type, category, severity, pattern, confidence) in the order in which they decide: confidence, then place.

    A later pattern replaces an earlier one only by a strictly higher confidence, so the first pattern of the highest confidence wins.
    """
    flat = [(t, c, s, p, k) for t, c, s, patterns in DICTIONARY for p, k in patterns]
    flat += [(t.name, "custom", t.severity, p, "high") for t in custom for p in t.patterns]
    order = sorted(range(len(flat)), key=lambda i: (-CONFIDENCE_RANK[flat[i][4]], i))
    return [(i, *flat[i]) for i in order]


#: Names a pattern may stand for to be looked up instead of matched.
MAX_SPELLINGS = 5_000


def _spellings(parts) -> list[str]:  # noqa: ANN001
    """All texts that a parsed pattern of letters, choices and bounded repetition matches; raises ValueError for any other."""
    out = [""]
    for op, value in parts:
        match str(op):
            case "LITERAL":
                each = [chr(value)]
            case "IN" if all(str(o) == "LITERAL" for o, _ in value):
                each = [chr(v) for _, v in value]
            case "SUBPATTERN":
                each = _spellings(value[-1])
            case "BRANCH":
                each = [x for branch in value[1] for x in _spellings(branch)]
            case "MAX_REPEAT" if value[1] <= 4:
                once, run, each = _spellings(value[2]), [""], [""] if value[0] == 0 else []
                for n in range(1, value[1] + 1):
                    run = [x + y for x in run for y in once]
                    each += run if n >= value[0] else []
            case _:
                raise ValueError(op)
        if len(out) * len(each) > MAX_SPELLINGS:
            raise ValueError("too many spellings")
        out = [x + y for x in out for y in each]
    return out


def spellings(pattern: str) -> list[str] | None:
    """The lower-case names an anchored pattern matches, or None if they are not finite and few."""
    try:
        parts = list(_parser.parse(pattern))
        if [str(op) for op, _ in (parts[0], parts[-1])] == ["AT", "AT"] and str(parts[0][1]) == "AT_BEGINNING" and str(parts[-1][1]) == "AT_END":
            return [x.lower() for x in _spellings(parts[1:-1])]
    except (ValueError, IndexError, re.error):
        pass
    return None


@dataclass(frozen=True)
class Lookup:
    """The dictionary as names with their deciding entry, and the patterns that stay patterns, in the order in which they decide."""

    names: dict[str, tuple[str, str, str, str]]
    patterns: list[tuple[str, str, str, str, str]]


@cache
def _lookup(custom: tuple) -> Lookup:
    entries = dictionary_entries([CustomType(n, list(p), s) for n, p, s in custom])
    spelt = [(e, spellings(e[4])) for e in entries]
    patterns = [(n, re.compile(e[4], re.I), e) for n, (e, names) in enumerate(spelt) if names is None]
    first: dict[str, int] = {}
    for n, (_, names) in enumerate(spelt):
        for x in names or ():
            first.setdefault(x, n)
    for x, n in first.items():
        first[x] = min([n, *(m for m, p, _ in patterns if m < n and p.search(x))])
    decided = {x: (entries[n][1], entries[n][2], entries[n][3], entries[n][5]) for x, n in first.items()}
    return Lookup(decided, [(e[4], e[1], e[2], e[3], e[5]) for _, _, e in patterns])


def lookup(custom: Sequence[CustomType] = ()) -> Lookup:
    """How names are matched: most patterns stand for a few names each."""
    return _lookup(tuple((t.name, tuple(t.patterns), t.severity) for t in custom))


def _like_any(name: Column, patterns: Sequence[str]) -> Column:
    return name.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_dictionary_sql(name: str, custom: Sequence[CustomType] = ()) -> str:
    """SQL for whether a name (given as SQL) is matched and not safe: one set and one alternation, for use inside arrays too."""
    table = lookup(custom)
    listed = f"lower({name}) IN ({', '.join(map(_sql_text, sorted(set(table.names) - set(SAFE_NAMES))))})"
    some = _sql_text("(?i)" + "|".join(f"(?:{p[0]})" for p in table.patterns))
    safe = ", ".join(map(_sql_text, SAFE_NAMES))
    return f"({listed} OR ({name} RLIKE {some} AND lower({name}) NOT IN ({safe})))"


def match_names(names: DataFrame, name_col: str, custom: Sequence[CustomType] = ()) -> DataFrame:
    """``names`` with pii_type, category, severity and confidence of each name that matches: a map, without a shuffle.

    Names that patterns spell out are looked up in a broadcast table (as large as the rules, at most ``MAX_SPELLINGS`` names a pattern); only
    others meet the few patterns that stand for any number of names.
    """
    table = lookup(custom)
    keys = list(table.names)
    columns = ["pii_type", "category", "severity", "confidence"]
    spelt = pa.table({"_name": keys} | {c: [table.names[k][i] for k in keys] for i, c in enumerate(columns)})
    rules = F.broadcast(names.sparkSession.createDataFrame(spelt).withColumn("_spelt", F.struct(*columns)).select("_name", "_spelt"))
    name = F.col(name_col)
    matched = names.where(~is_safe(name)).join(rules, F.lower(name) == F.col("_name"), "left").drop("_name")
    some = _like_any(name, [p[0] for p in table.patterns])
    matched = matched.where(F.col("_spelt").isNotNull() | some)
    rest = [F.when(name.rlike(f"(?i){p}"), F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, e, strict=True)])) for p, *e in table.patterns]
    return matched.withColumn("_spelt", F.coalesce("_spelt", *rest)).select(*names.columns, "_spelt.*")


def is_safe(name: Column) -> Column:
    """Names of programming that contain words of personal data."""
    return F.lower(name).isin(SAFE_NAMES)


def in_test_context(path: Column) -> Column:
    """Whether a path belongs to tests or fixtures."""
    return F.lower(path).rlike(TEST_CONTEXT)


def in_example_context(line: Column) -> Column:
    """Whether a line shows example data."""
    low = F.lower(line)
    address = low.contains("example.com") & (low.contains('"test') | low.contains('"user@') | low.contains('"demo'))
    marks = ("// example", "# example", "// dummy", "# dummy", "// placeholder", "// mock", "todo!")
    return reduce(lambda a, m: a | low.contains(m), marks, address)


def literal_type(text: Column) -> Column:
    """The first type, in order, whose pattern is found in a text, or null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(t)) for t, p in LITERALS])


def _ends(text: Column, ends: Sequence[str]) -> Column:
    return reduce(lambda a, e: a | text.endswith(e), ends[1:], text.endswith(ends[0]))


def sink_kind(callee: Column, custom: Sequence[CustomSink] = (), low: Column | None = None) -> Column:
    """Where a call takes data: log, database, third party, response, then custom sinks; null for none and for allowed ones. ``low`` is the callee in lower case."""
    low = F.lower(callee) if low is None else low
    log = low.isin(LOG_CALLS) | (_ends(callee, LOG_ENDS) & low.contains("log"))
    http = reduce(lambda a, s: a | low.startswith(s), HTTP_STARTS[1:], low.startswith(HTTP_STARTS[0]))
    holders = reduce(lambda a, h: a | low.contains(h), RESPONSE_HOLDERS[1:], low.contains(RESPONSE_HOLDERS[0]))
    out = F.when(log, "log_output").when(_ends(low, DATABASE_ENDS), "database").when(http, "third_party_api").when(_ends(low, RESPONSE_ENDS) & holders, "response")
    for s in custom:
        out = out.when(callee.rlike(s.pattern), F.lit(None) if s.allowed else F.lit(s.kind))
    return out


def rank(level: Column, order: dict[str, int]) -> Column:
    """Number of a level (case ignored); unknown and null count as the lowest."""
    low = F.lower(F.trim(level))
    return F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in order.items()], F.lit(0))


def level_of(number: Column, order: dict[str, int]) -> Column:
    """Level of a number."""
    return F.coalesce(*[F.when(number == v, F.lit(k)) for k, v in order.items()])
