"""Boolean trigram queries from regular expressions.

A query is a list of alternatives, each the set of trigrams that a matching text must hold, all in lower case.
``None`` means that the expression has no mandatory trigram in some alternative, so every text must be read.
"""

from __future__ import annotations

import re
from itertools import product

#: Sets of possible literal strings beyond this size count as "anything".
MOST_STRINGS = 24

Query = list[frozenset] | None


def trigrams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def least(query: list[frozenset]) -> list[frozenset]:
    """Without alternatives that ask for more than another one."""
    return [x for x in dict.fromkeys(query) if not any(y < x for y in query)]


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return least([x | y for x, y in product(a, b)])


def of_strings(strings: set[str]) -> Query:
    """A text that holds one of the strings."""
    found = [trigrams(s) for s in sorted(strings)]
    return None if not all(found) else least(found)


def read(items) -> tuple[Query, set[str] | None]:
    """The query of a sequence, and the strings that it can be in full, if those are few."""
    query, exact, whole = None, {""}, True

    def flush():
        nonlocal query, exact, whole
        query, exact, whole = both(query, of_strings(exact)), {""}, False

    for op, arg in items:
        strings, below = None, None
        name = str(op)
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            strings = {chr(c).lower() for o, a in arg for c in (range(a[0], a[1] + 1) if str(o) == "RANGE" else [a])}
        elif name == "SUBPATTERN":
            below, strings = read(arg[-1])
        elif name == "BRANCH":
            parts = [read(x) for x in arg[1]]
            if all(s is not None for _, s in parts):
                strings = set().union(*(s for _, s in parts))
            else:
                each = [both(q, of_strings(s)) if s is not None else q for q, s in parts]
                below = None if any(q is None for q in each) else [x for q in each for x in q]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, sub = arg
            below, strings = read(sub)
            if low == high == 1:
                pass
            elif low == 0 and high == 1 and strings is not None:
                strings, below = strings | {""}, None
            elif low == 0:
                strings, below = None, None
            elif strings is not None:  # the last of the repeats ends here, what follows may continue it
                below, strings = of_strings(strings), None
        if strings is not None and len(strings) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a, b in product(exact, strings)}
        else:
            flush()
            if strings is not None and len(strings) <= MOST_STRINGS:
                exact = set(strings)
        query = both(query, below)
    if whole:
        return query, exact
    flush()
    return query, None


def trigram_query(pattern: str) -> Query:
    query, exact = read(re._parser.parse(pattern))
    return both(query, of_strings(exact)) if exact is not None else query
