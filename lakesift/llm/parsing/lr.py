"""Generalised LR parsing from tables: SLR(1) tables are built from a grammar text, conflicts are kept and followed in parallel.

Notation of a grammar: ``Name : alternative | alternative ;`` with terminals in quotes or in capitals, ``( )`` groups, ``? * +`` and ``%``
for separated lists (``X % ','``). Empty productions are removed, so a parse makes no empty reductions and always ends.

A stack is a chain of (state, rest) pairs; stacks that meet in the same state on the same rest are one. Where a grammar is ambiguous
the alternatives reduce to the same symbol over the same rest and meet again, so recognising needs no forest.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

_SPEC = re.compile(r"\s*(?:(#[^\n]*)|('(?:[^'\\]|\\.)*')|(\w+)|([:|;()?*+%]))")
END = "$end"


@dataclass
class Tables:
    """What parsing needs: terminals by number, actions per state, and the grammar's start."""

    terminals: dict[str, int]
    #: per state: terminal -> tuple of actions; n >= 0 shifts to state n, n < 0 reduces by production ~n
    actions: list[dict[int, tuple[int, ...]]]
    gotos: list[dict[int, int]]
    lengths: list[int]
    heads: list[int]
    accept: int = 0
    contextual: frozenset[str] = field(default_factory=frozenset)
    #: what ``_after_units`` gave before
    units: dict[tuple[int, int, int], int] = field(default_factory=dict)


def _read(text: str) -> dict[str, list[list]]:
    """Rules as nested lists: a sequence of items, each (kind, value...)."""
    tokens = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _SPEC.match(text, at)
        if not m:
            raise ValueError(f"grammar near {text[at : at + 40]!r}")
        at = m.end()
        if m[1] is None:
            tokens.append(m[2] or m[3] or m[4])
    rules: dict[str, list[list]] = {}
    i = 0

    def alternatives(stop: str) -> list[list]:
        nonlocal i
        out: list[list] = [[]]
        while tokens[i] != stop:
            t = tokens[i]
            i += 1
            if t == "|":
                out.append([])
                continue
            item: tuple = ("group", None) if t == "(" else ("sym", t)
            if t == "(":
                item = ("group", alternatives(")"))
                i += 1
            while i < len(tokens) and tokens[i] in "?*+%" and len(tokens[i]) == 1:
                op = tokens[i]
                i += 1
                if op == "%":
                    sep = tokens[i]
                    i += 1
                    item = ("list", item, sep)
                else:
                    item = (op, item)
            out[-1].append(item)
        return out

    while i < len(tokens):
        name = tokens[i]
        if tokens[i + 1] != ":":
            raise ValueError(f"grammar at {name}")
        i += 2
        rules.setdefault(name, []).extend(alternatives(";"))
        i += 1
    return rules


def _expand(rules: dict[str, list[list]]) -> list[tuple[str, tuple[str, ...]]]:
    """Plain productions without repetition signs and without empty right sides."""
    out: dict[str, set[tuple[str, ...]]] = defaultdict(set)
    made: dict[str, str] = {}

    def symbol(item: tuple) -> str:
        if item[0] == "sym":
            return item[1]
        key = repr(item)
        if key in made:
            return made[key]
        name = made[key] = f"_{len(made)}"
        if item[0] == "group":
            for alt in item[1]:
                out[name].add(tuple(symbol(x) for x in alt))
        elif item[0] == "?":
            out[name] |= {(), (symbol(item[1]),)}
        elif item[0] in "*+":
            plus = f"{name}p"
            x = symbol(item[1])
            out[plus] |= {(x,), (plus, x)}
            out[name] |= {(plus,)} | ({()} if item[0] == "*" else set())
        else:
            x = symbol(item[1])
            out[name] |= {(x,), (name, item[2], x)}
        return name

    for name, alts in rules.items():
        for alt in alts:
            out[name].add(tuple(symbol(x) for x in alt))
    nullable: set[str] = set()
    changed = True
    while changed:
        changed = False
        for name, alts in out.items():
            if name not in nullable and any(all(s in nullable for s in a) for a in alts):
                nullable.add(name)
                changed = True
    prods = set()
    for name, alts in out.items():
        for alt in alts:
            forms = [()]
            for s in alt:
                forms = [f + (s,) for f in forms] + ([*forms] if s in nullable else [])
            prods |= {(name, f) for f in forms if f and f != (name,)}
    live = {n for n, _ in prods}
    known = set(out)
    prods = {(n, f) for n, f in prods if all(s not in known or s in live for s in f)}
    start = next(iter(rules))
    if start in nullable:
        prods.add((start, ("EMPTY",)))
    return sorted(prods)


def build(text: str, contextual: frozenset[str] | set[str] = frozenset()) -> Tables:
    """SLR(1) tables of a grammar; ``contextual`` words are terminals that may also be names."""
    rules = _read(text)
    prods = _expand(rules)
    start = next(iter(rules))
    nonterminals = sorted({n for n, _ in prods})
    nt = {n: i for i, n in enumerate(nonterminals)}
    term: dict[str, int] = {END: 0}
    for _, f in prods:
        for s in f:
            if s not in nt:
                term.setdefault(s, len(term))
    prods = [("$start", (start,)), *prods]
    by_head: dict[str, list[int]] = defaultdict(list)
    for i, (n, _) in enumerate(prods):
        by_head[n].append(i)
    first: dict[str, set[int]] = defaultdict(set)
    follow: dict[str, set[int]] = defaultdict(set)
    follow["$start"].add(0)
    changed = True
    while changed:
        changed = False
        for n, f in prods:
            new = {term[f[0]]} if f[0] in term else first[f[0]]
            if not new <= first[n]:
                first[n] |= new
                changed = True
    changed = True
    while changed:
        changed = False
        for n, f in prods:
            for a, b in zip(f, [*f[1:], None], strict=True):
                if a in nt:
                    new = follow[n] if b is None else ({term[b]} if b in term else first[b])
                    if not new <= follow[a]:
                        follow[a] |= new
                        changed = True
    closures: dict[str, frozenset] = {}

    def heads_from(s: str) -> frozenset:
        """Productions that may begin where ``s`` is expected."""
        if s not in closures:
            seen, todo = set(), [s]
            while todo:
                x = todo.pop()
                if x in nt and x not in seen:
                    seen.add(x)
                    todo += [prods[p][1][0] for p in by_head[x]]
            closures[s] = frozenset((p, 0) for x in seen for p in by_head[x])
        return closures[s]

    def close(kernel: frozenset) -> set:
        items = set(kernel)
        for p, d in kernel:
            f = prods[p][1]
            if d < len(f) and f[d] in nt:
                items |= heads_from(f[d])
        return items

    initial = frozenset([(0, 0)])
    states = {initial: 0}
    todo = [initial]
    actions: list[dict[int, list[int]]] = []
    gotos: list[dict[int, int]] = []
    at = 0
    while at < len(todo):
        moves: dict[str, set] = defaultdict(set)
        acts: dict[int, list[int]] = defaultdict(list)
        for p, d in close(todo[at]):
            n, f = prods[p]
            if d < len(f):
                moves[f[d]].add((p, d + 1))
            elif p == 0:
                acts[0].append(~0)
            else:
                for t in follow[n]:
                    acts[t].append(~p)
        goto: dict[int, int] = {}
        for s, kernel in sorted(moves.items()):
            k = frozenset(kernel)
            if k not in states:
                states[k] = len(states)
                todo.append(k)
            if s in term:
                acts[term[s]].append(states[k])
            else:
                goto[nt[s]] = states[k]
        actions.append(acts)
        gotos.append(goto)
        at += 1
    frozen = [{t: tuple(sorted(a, reverse=True)) for t, a in acts.items()} for acts in actions]
    lengths = [len(f) for _, f in prods]
    heads = [nt.get(n, -1) for n, _ in prods]
    return Tables(term, frozen, gotos, lengths, heads, 0, frozenset(contextual))


def _after_units(tables: Tables, below: int, state: int, kind: int) -> int:
    """The state that is reached from ``state``, on top of ``below``, by the reductions of one symbol to another that ``kind`` alone decides."""
    while True:
        acts = tables.actions[state].get(kind)
        if acts is None or len(acts) > 1 or acts[0] >= -1 or tables.lengths[~acts[0]] != 1:
            return state
        state = tables.gotos[below][tables.heads[~acts[0]]]


def feed(tables: Tables, tops: list, kinds: tuple[int, ...]) -> tuple[list, bool]:
    """The stacks after one token (any of ``kinds``), and whether the input may end here."""
    actions, gotos, lengths, heads = tables.actions, tables.gotos, tables.lengths, tables.heads
    if len(tops) == 1:
        node = tops[0]
        if len(kinds) > 1:
            here = actions[node[0]]
            kinds = tuple(k for k in kinds if k in here)  # readings that the only stack cannot take
        if len(kinds) == 1:
            # One stack, one reading: follow it as long as there is one action.
            kind, units = kinds[0], tables.units
            while True:
                acts = actions[node[0]].get(kind)
                if acts is None:
                    return [], False
                if len(acts) > 1:
                    tops = [node]
                    break
                a = acts[0]
                if a >= 0:
                    return [(a, node)], False
                if a == -1:
                    return [], True
                p = ~a
                n = lengths[p]
                if n == 1:  # expressions climb many rules of one symbol: the way is looked up
                    below = node[1]
                    key = (below[0], node[0], kind)
                    state = units.get(key)
                    if state is None:
                        state = units[key] = _after_units(tables, *key)
                    node = (state, below)
                    continue
                while n:
                    node = node[1]
                    n -= 1
                node = (gotos[node[0]][heads[p]], node)
    shifted: dict[tuple[int, int], tuple] = {}
    ended = False
    for kind in kinds:
        seen: dict[tuple[int, int], tuple] = {(t[0], id(t[1])): t for t in tops}
        work = list(tops)
        while work:
            node = work.pop()
            acts = actions[node[0]].get(kind)
            if acts is None:
                continue
            if len(acts) == 1 and acts[0] < -1 and lengths[~acts[0]] == 1:
                below = node[1]
                way = (below[0], node[0], kind)
                state = tables.units.get(way)
                if state is None:
                    state = tables.units[way] = _after_units(tables, *way)
                key = (state, id(below))
                if key not in seen:
                    seen[key] = new = (state, below)
                    work.append(new)
                continue
            for a in acts:
                if a >= 0:
                    shifted[(a, id(node))] = (a, node)
                elif a == -1:
                    ended = True
                else:
                    p = ~a
                    base = node
                    for _ in range(lengths[p]):
                        base = base[1]
                    state = gotos[base[0]].get(heads[p])
                    if state is None:
                        continue
                    key = (state, id(base))
                    if key not in seen:
                        seen[key] = new = (state, base)
                        work.append(new)
    return list(shifted.values()), ended


def first_error(tables: Tables, tokens: list[tuple[tuple[int, ...], int, bool]], inserted: int | None = None, closers: frozenset[int] = frozenset()) -> int | None:
    """Index of the first token no stack can take, or None if the whole input is a sentence.

    ``tokens`` are (kinds, place, after a line break), ending with the end mark. ``inserted`` is a terminal (the semicolon) that is put in where
    a token cannot be taken and stands after a line break or is one of ``closers``.
    """
    if len(tokens) == 1 and "EMPTY" in tables.terminals:
        return None
    tops: list = [(0, None)]
    last = len(tokens) - 1
    for i, (kinds, _, fresh_line) in enumerate(tokens):
        after, ended = feed(tables, tops, kinds)
        if i == last and ended:
            return None
        if not after and inserted is not None and (fresh_line or kinds[0] in closers):
            tops, _ = feed(tables, tops, (inserted,))
            if tops:
                after, ended = feed(tables, tops, kinds)
                if i == last and ended:
                    return None
        if not after:
            return i
        tops = after
    return last
