"""Boolean trigram queries of regular expressions.

A query is True (no condition), a trigram, or ``("and"|"or", parts)``. Every
string an expression matches satisfies its query, so the query selects a
superset of the matching texts. Literals are lowered (A-Z), for an index over
lowered texts.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser as parser

MAX_STRINGS = 24          # spellings of one stretch of an expression that are written out
Query = bool | str | tuple


def lowered(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def combined(op: str, parts: list[Query]) -> Query:
    """``and`` / ``or`` of queries, flattened, without repetitions."""
    if op == "or" and any(p is True for p in parts):
        return True
    flat: list[Query] = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == op else [] if p is True else [p]
    flat = list(dict.fromkeys(flat))
    if op == "or":                       # a or (a and b) is a
        needs = {p: frozenset([p] if isinstance(p, str) else p[1]) for p in flat}
        flat = [p for p in flat if not any(needs[q] < needs[p] for q in flat)]
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (op, tuple(flat))


def of_strings(strings: set[str]) -> Query:
    """Any of ``strings`` occurs: all trigrams of one of them."""
    return combined("or", [combined("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _spellings(op, arg) -> set[str] | None:
    """All strings of a node, lowered; None if they are more than a few."""
    if op == C.LITERAL:
        return {lowered(chr(arg))}
    if op == C.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind == C.LITERAL:
                found.add(lowered(chr(value)))
            elif kind == C.RANGE and value[1] - value[0] < MAX_STRINGS:
                found |= {lowered(chr(c)) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= MAX_STRINGS else None
    if op == C.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op == C.BRANCH:
        sets = [_sequence(b)[0] for b in arg[1]]
        return None if any(s is None for s in sets) or len(set().union(*sets)) > MAX_STRINGS else set().union(*sets)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] != C.MAXREPEAT and arg[1] <= 4:
        item = _sequence(arg[2])[0]
        if item is None:
            return None
        found, power = set(), {""}
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                found |= power
            power = {a + b for a in power for b in item}
            if len(found) + len(power) > MAX_STRINGS * 4:
                return None
        return found if len(found) <= MAX_STRINGS else None
    return {""} if op == C.AT else None


def _condition(op, arg) -> Query:
    """Query of a node whose strings cannot be written out."""
    if op == C.SUBPATTERN:
        return _sequence(arg[3])[1]
    if op == C.BRANCH:
        return combined("or", [_sequence(b)[1] for b in arg[1]])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
        return _sequence(arg[2])[1]
    return True


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    """(all strings or None, query) of a sequence of nodes."""
    parts: list[Query] = []
    held, whole = {""}, True
    for op, arg in nodes:
        more = _spellings(op, arg)
        if more is not None and len(held) * len(more) <= MAX_STRINGS:
            held = {a + b for a in held for b in more}
            continue
        whole = False
        parts.append(of_strings(held))
        if more is None:
            parts.append(_condition(op, arg))
            held = {""}
        else:
            held = more
    parts.append(of_strings(held))
    return (held if whole else None), combined("and", parts)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of ``pattern``; True if it has no mandatory trigram."""
    return _sequence(parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*(trigrams(p) for p in query[1]))


MAX_CLAUSES = 256


def clauses(query: Query) -> list[tuple[str, ...]] | None:
    """``query`` as a list of alternatives, each a set of trigrams that must all
    occur. None: no condition. A part that would multiply the alternatives
    beyond ``MAX_CLAUSES`` is left out, which only selects more texts."""
    if query is True:
        return None
    if isinstance(query, str):
        return [(query,)]
    if query[0] == "or":
        return [c for part in query[1] for c in clauses(part)]
    out: list[tuple[str, ...]] = [()]
    for part in sorted(query[1], key=lambda p: not isinstance(p, str)):
        more = clauses(part)
        if len(out) * len(more) <= MAX_CLAUSES:
            out = [tuple(sorted({*a, *b})) for a in out for b in more]
    return None if () in out else out
