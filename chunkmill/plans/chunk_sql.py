"""SQL for the chunkers whose cuts depend on the one before: recursive queries that follow, from every possible start, its next one.

Each function takes a query with the columns ``doc_id`` and ``t`` and gives one with ``doc_id, i, start_idx, end_idx, n`` and,
for the recursive chunker, ``level``: the chunks in order of ``i``, in characters.
"""

from __future__ import annotations

#: White space as JavaScript has it, for RE2.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def split_sql(pattern: str) -> str:
    """Parts of ``t`` that end with a match of the pattern, and the rest."""
    return f"regexp_extract_all(t, '(?s)(?:.*?(?:{pattern})|.+)')"


def fast_sql(source: str, size: int, delimiters: str) -> str:
    """Windows of bytes: to the last delimiter that isn't the window's first byte, else to the last character that fits, else one character."""
    marks = ", ".join(f"chr({ord(d)})" for d in delimiters)
    return f"""WITH RECURSIVE s AS MATERIALIZED ({source}),
u AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM s WHERE length(t) > 0),
c AS MATERIALIZED (SELECT doc_id, i, c, CAST(sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM u),
w AS (SELECT doc_id, i, max(i) OVER inside AS fits, max(CASE WHEN c IN ({marks}) THEN i END) OVER inside AS mark FROM c WINDOW inside AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN CURRENT ROW AND greatest({size} - strlen(c), 0) FOLLOWING)),
p AS MATERIALIZED (SELECT doc_id, i - 1 AS a, CASE WHEN mark > i THEN mark ELSE fits END AS b FROM w),
r AS (SELECT doc_id, 0 AS i, a, b FROM p WHERE a = 0 UNION ALL SELECT p.doc_id, r.i + 1, p.a, p.b FROM r JOIN p ON p.doc_id = r.doc_id AND p.a = r.b)
SELECT doc_id, i, a AS start_idx, b AS end_idx, b - a AS n FROM r"""


#: Tokens of a text ``x``: a sum over its parts, and what is added once per text.
CHARACTERS, WORDS = ("length(x)", 0), ("length(x) - length(replace(x, ' ', ''))", 1)


def sentence_sql(source: str, size: int, overlap: int, pattern: str, tokens: tuple[str, int] = CHARACTERS) -> str:
    """Sentences packed up to the size; the next chunk begins at the last sentence from which the overlap is full, one further at least."""
    return f"""WITH RECURSIVE s AS MATERIALIZED ({source}),
u AS (SELECT doc_id, unnest({split_sql(pattern)}) AS x, generate_subscripts({split_sql(pattern)}, 1) AS i FROM s WHERE length(t) > 0),
m AS (SELECT doc_id, i, length(x) AS l, {tokens[0]} + {tokens[1]} AS k FROM u),
c AS MATERIALIZED (SELECT doc_id, i, CAST(sum(k) OVER w AS BIGINT) AS upto, CAST(sum(k) OVER w AS BIGINT) - k AS low, CAST(sum(l) OVER w AS BIGINT) AS right_, CAST(sum(l) OVER w AS BIGINT) - l AS left_ FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, max(i) AS last FROM c GROUP BY doc_id),
f AS (SELECT c.doc_id, c.i, c.low, c.left_, greatest(c.i, coalesce(x.i, 0)) AS to_ FROM c ASOF LEFT JOIN c x ON c.doc_id = x.doc_id AND c.low + {size} >= x.upto),
g AS (SELECT f.*, c.upto AS high, c.right_, c.upto - {overlap} AS back FROM f JOIN c ON c.doc_id = f.doc_id AND c.i = f.to_),
h AS (SELECT g.*, x.i AS again FROM g ASOF LEFT JOIN c x ON g.doc_id = x.doc_id AND g.back >= x.low),
p AS MATERIALIZED (SELECT h.doc_id, h.i AS a, left_, right_, high - low AS n, CASE WHEN to_ = last THEN NULL WHEN {overlap} = 0 THEN to_ + 1 WHEN again IS NULL THEN h.i + 1 ELSE greatest(least(again, to_), h.i + 1) END AS next FROM h JOIN n ON n.doc_id = h.doc_id),
r AS (SELECT doc_id, 0 AS i, left_, right_, n, next FROM p WHERE a = 1 UNION ALL SELECT p.doc_id, r.i + 1, p.left_, p.right_, p.n, p.next FROM r JOIN p ON p.doc_id = r.doc_id AND p.a = r.next)
SELECT doc_id, i, left_ AS start_idx, right_ AS end_idx, n FROM r"""


def level_sql(k: int, size: int, least: int, pattern: str, tokens: tuple[str, int]) -> str:
    """One rule: spans ``s{k}`` (doc_id, base, t) to packed pieces ``q{k}`` (doc_id, a, b, n); a short part joins the one before, a short first one the next."""
    return f"""u{k} AS (SELECT doc_id, base, unnest({split_sql(pattern)}) AS x, generate_subscripts({split_sql(pattern)}, 1) AS i FROM s{k}),
v{k} AS (SELECT doc_id, base, i, length(x) AS l, {tokens[0]} AS m, sum(CASE WHEN i > 1 AND length(x) >= {least} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, base ORDER BY i) AS g FROM u{k}),
w{k} AS (SELECT doc_id, base, g, sum(l) AS l, sum(m) AS m FROM v{k} GROUP BY ALL),
x{k} AS (SELECT doc_id, base, CASE WHEN g = 1 AND first_value(l) OVER (PARTITION BY doc_id, base ORDER BY g) < {least} THEN 0 ELSE g END AS g, l, m FROM w{k}),
y{k} AS (SELECT doc_id, base, g, sum(l) AS l, sum(m) + {tokens[1]} AS m FROM (SELECT doc_id, base, g, l, m FROM x{k}) GROUP BY doc_id, base, g),
c{k} AS MATERIALIZED (SELECT doc_id, base, row_number() OVER o AS i, CAST(sum(m) OVER o AS BIGINT) AS upto, CAST(sum(m) OVER o AS BIGINT) - m AS low, CAST(sum(l) OVER o AS BIGINT) AS right_, CAST(sum(l) OVER o AS BIGINT) - l AS left_ FROM y{k} WINDOW o AS (PARTITION BY doc_id, base ORDER BY g)),
f{k} AS (SELECT c.doc_id, c.base, c.i, c.low, c.left_, greatest(c.i, coalesce(x.i, 0)) AS to_ FROM c{k} c ASOF LEFT JOIN c{k} x ON c.doc_id = x.doc_id AND c.base = x.base AND c.low + {size} >= x.upto),
p{k} AS MATERIALIZED (SELECT f.doc_id, f.base, f.i, f.left_, c.right_, c.upto - f.low AS n, f.to_ FROM f{k} f JOIN c{k} c ON c.doc_id = f.doc_id AND c.base = f.base AND c.i = f.to_),
r{k} AS (SELECT doc_id, base, left_, right_, n, to_ FROM p{k} WHERE i = 1 UNION ALL SELECT p.doc_id, p.base, p.left_, p.right_, p.n, p.to_ FROM r{k} r JOIN p{k} p ON p.doc_id = r.doc_id AND p.base = r.base AND p.i = r.to_ + 1),
q{k} AS MATERIALIZED (SELECT doc_id, CAST(base + left_ AS BIGINT) AS a, CAST(base + right_ AS BIGINT) AS b, CAST(n AS BIGINT) AS n FROM r{k})"""


def recursive_sql(source: str, size: int, least: int, tokens: tuple[str, int] = CHARACTERS) -> str:
    """Paragraphs, lines, words, then windows of tokens; ``x`` is a chunk's text where it isn't the one between its positions."""
    parts = [f"WITH RECURSIVE s AS MATERIALIZED ({source}), s0 AS (SELECT doc_id, CAST(0 AS BIGINT) AS base, t FROM s WHERE length(t) > 0)"]
    for k, pattern in enumerate((r"\n\n", r"\n", f"{SPACE}+")):
        parts.append(level_sql(k, size, least, pattern, tokens))
        parts.append(f"s{k + 1} AS (SELECT q.doc_id, q.a AS base, substring(s.t, q.a + 1, q.b - q.a) AS t FROM q{k} q JOIN s ON s.doc_id = q.doc_id WHERE q.n > {size})")
    kept = " UNION ALL ".join(f"SELECT doc_id, a, b, n, {k} AS level, NULL AS x FROM q{k} WHERE n <= {size}" for k in range(3))
    windows = word_windows(size) if tokens == WORDS else f"SELECT doc_id, a, b, b - a AS n, -1 AS level, NULL AS x FROM (SELECT doc_id, base + k * {size} AS a, base + least((k + 1) * {size}, length(t)) AS b FROM (SELECT *, unnest(range(0, CAST(ceil(length(t) / {size}.0) AS BIGINT))) AS k FROM s3))"
    return ", ".join(parts) + f" SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS i, a AS start_idx, b AS end_idx, n, level, x FROM ({kept} UNION ALL {windows})"


def word_windows(size: int) -> str:
    """Windows of words with their texts, as positions follow the joined texts and not the places they came from."""
    return f"""SELECT doc_id, base + upto - length(x) AS a, base + upto AS b, n, -1 AS level, x FROM (SELECT *, CAST(sum(length(x)) OVER (PARTITION BY doc_id, base ORDER BY k) AS BIGINT) AS upto
FROM (SELECT doc_id, base, k, array_to_string(l[k * {size} + 1 : (k + 1) * {size}], ' ') AS x, len(l[k * {size} + 1 : (k + 1) * {size}]) AS n FROM (SELECT doc_id, base, string_split(t, ' ') AS l, unnest(range(0, CAST(ceil(len(string_split(t, ' ')) / {size}.0) AS BIGINT))) AS k FROM s3)))"""
