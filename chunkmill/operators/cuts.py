"""Small helpers that cut one text where each cut depends on the one before. They run inside tasks, on Arrow batches.

A chunk is (text, start, end, tokens, metadata or None), positions in code points; ``in_utf16`` turns them to UTF-16
units where a text needs it.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np

from ..functions.config import FastConfig, RecursiveConfig, Rule, SentenceConfig, TableConfig, TokenConfig
from ..functions.text import CELL, JS_SPACE, LINE_ENDS, SPACES, delimiter_pattern
from ..functions.tokenizers import TextTokenizer

RUNS = re.compile(f"[{JS_SPACE}]+")
SEPARATOR_CELL = re.compile(CELL)
OTHER_ENDS = re.compile(f"[{LINE_ENDS}]")

Chunk = tuple[str, int, int, int, dict | None]


def trim(text: str) -> str:
    return text.strip(SPACES)


def is_pipe(line: str) -> bool:
    own = line.strip(SPACES)
    return len(own) > 1 and own[0] == own[-1] == "|" and (own.isascii() and "\r" not in own and "\n" not in own or OTHER_ENDS.search(own) is None)


def is_separator(line: str) -> bool:
    """Two cells of dashes at least, whose pipes may enclose the line."""
    if "---" not in line:
        return False
    cells = trim(line).removeprefix("|").removesuffix("|").split("|")
    if len(cells) < 2:
        return False
    for c in cells:
        if not SEPARATOR_CELL.fullmatch(c.strip(SPACES)):
            return False
    return True


def in_utf16(text: str, chunks: list[Chunk]) -> list[Chunk]:
    if text.isascii() or max(text, default="") < "\U00010000":
        return chunks
    wide = [0, *accumulate(1 + (c >= "\U00010000") for c in text)]
    return [(t, wide[min(a, len(text))], wide[min(b, len(text))], n, m) for t, a, b, n, m in chunks]


def split_at(text: str, pattern: re.Pattern, include: str | None) -> list[tuple[int, int]]:
    """Spans of the parts, the delimiter with the part before, the next one, or neither."""
    found = [m.span() for m in pattern.finditer(text)]
    if include == "prev":
        cuts = [0, *(b for _, b in found), len(text)]
        parts = list(zip(cuts, cuts[1:]))
    elif include == "next":
        cuts = [0, *(a for a, _ in found), len(text)]
        parts = list(zip(cuts, cuts[1:]))
    else:
        parts = list(zip([0, *(b for _, b in found)], [*(a for a, _ in found), len(text)]))
    return [(a, b) for a, b in parts if a < b]


def fast(text: str, config: FastConfig) -> list[Chunk]:
    """Windows of bytes that end after the last delimiter byte inside, or at a character's edge.

    Edges of characters and ends of delimiters are found once; each window looks its own up.
    """
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    edges = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # the i-th character starts at edges[i]
    marks = np.flatnonzero(np.isin(data, [ord(d) for d in config.delimiters if len(d) == 1 and ord(d) < 256])) + 1
    out, at = [], 0
    while at < len(edges) - 1:
        start = int(edges[at])
        end = min(start + config.chunk_size, len(data))
        last = int(np.searchsorted(marks, end, "right")) - 1
        if last >= 0 and marks[last] > start + 1:
            end = int(marks[last])
        to = int(np.searchsorted(edges, end, "right")) - 1
        if to <= at:  # a character longer than the window
            to = at + 1
        own = text[at:to]
        out.append((own, at, to, len(own.encode("utf-16-le", "surrogatepass")) // 2, None))
        at = to
    return out


def sentence(text: str, config: SentenceConfig) -> list[Chunk]:
    """Sentences packed up to the size; the next chunk steps back over sentences that make up the overlap."""
    spans = split_at(text, re.compile(delimiter_pattern(config.delimiters)), config.include_delim)
    total = [0, *accumulate(config.tokenizer.count_texts([text[a:b] for a, b in spans]))]
    out, first = [], 0
    while first < len(spans):
        end = first + 1
        while end < len(spans) and total[end] == total[first]:  # sentences without tokens before the first that has some
            end += 1
        end = max(end, bisect_right(total, total[first] + config.chunk_size, end) - 1)
        joined = "".join(text[a:b] for a, b in spans[first:end])
        out.append((joined, spans[first][0], spans[end - 1][1], total[end] - total[first], None))
        if config.chunk_overlap <= 0 or end == len(spans):
            first = end
            continue
        back = end - 1
        while back > first and total[end] - total[back] < config.chunk_overlap:
            back -= 1
        first = max(back, first + 1)
    return out


def token_windows(text: str, at: int, size: int, tokenizer: TextTokenizer) -> list[Chunk]:
    """Windows of tokens, joined; positions follow the joined texts."""
    tokens = tokenizer.split_text(text)
    out = []
    for i in range(0, len(tokens), size):
        own = tokenizer.join_tokens(tokens[i : i + size])
        out.append((own, at, at + len(own), tokenizer.count_window(tokens[i : i + size], own), {"recursive_rule_level": -1, "recursive_rule_type": "tokenFallback"}))
        at += len(own)
    return out


def windows(text: str, config: TokenConfig) -> list[Chunk]:
    """Token windows of a text; the overlap is the start of the next window."""
    tokenizer, size, over = config.tokenizer, config.chunk_size, config.chunk_overlap
    tokens = tokenizer.split_text(text)
    out, at = [], 0
    for i in range(0, max(len(tokens) - over, min(len(tokens), 1)), size - over):
        own = tokens[i : i + size]
        joined = tokenizer.join_tokens(own)
        start = at - len(tokenizer.join_tokens(own[:over])) if i else 0
        at = start + len(joined)
        out.append((joined, start, at, tokenizer.count_window(own, joined), None))
    return out


def utf16_sizes(text: str):
    """The length in UTF-16 units of a span of the text, as a function of its ends."""
    if text.isascii() or max(text, default="") < "\U00010000":
        return lambda a, b: b - a
    upto = [0, *accumulate(1 + (c >= "\U00010000") for c in text)]
    return lambda a, b: upto[b] - upto[a]


def long_enough(spans: list[tuple[int, int]], least: int, size) -> list[tuple[int, int]]:
    """Adjacent spans, so joined that none is short: a short one ends in the span before, a short first one takes the second in."""
    if len(spans) < 2 or least < 2:
        return spans
    starts = [a for a, b in spans[1:] if size(a, b) >= least]
    first = spans[0][0]
    if starts and size(first, starts[0]) < least:
        starts = starts[1:]
    cuts = [first, *starts, spans[-1][1]]
    return list(zip(cuts, cuts[1:]))


@functools.lru_cache(maxsize=64)
def parted_by(rule: Rule) -> re.Pattern:
    return re.compile(delimiter_pattern(rule.delimiters)) if rule.delimiters else RUNS


def recursive(text: str, config: RecursiveConfig) -> list[Chunk]:
    """Rule after rule on spans of the text: split, join short parts, join neighbours that fit; what is too large goes to the next rule."""
    count, size, units = config.tokenizer.count_texts, config.chunk_size, utf16_sizes(text)
    out, todo = [], [(0, len(text))]
    for level, rule in enumerate(config.rules):
        if not todo:
            break
        if not rule.delimiters and not rule.whitespace:
            out += [c for a, b in todo for c in token_windows(text[a:b], a, size, config.tokenizer)]
            return sorted(out, key=lambda c: c[1])
        pattern = parted_by(rule)
        about = {"recursive_rule_level": level, "recursive_rule_type": "delimiter" if rule.delimiters else "whitespace"}
        if rule.delimiters:
            about["recursive_delimiter"] = "|".join(rule.delimiters)
        below = []
        for begin, end in todo:
            parts = [(begin + a, begin + b) for a, b in split_at(text[begin:end], pattern, rule.include_delim or "prev")]
            parts = long_enough(parts, config.min_characters, units)
            total = [0, *accumulate(count([text[a:b] for a, b in parts]))]
            i = 0
            while i < len(parts):
                j = max(i + 1, bisect_right(total, total[i] + size, i + 1) - 1)
                a, b, n = parts[i][0], parts[j - 1][1], total[j] - total[i]
                if n > size:
                    below.append((a, b))
                else:
                    out.append((text[a:b], a, b, n, about))
                i = j
        todo = below
    for (a, b), n in zip(todo, count([text[a:b] for a, b in todo])):
        out += token_windows(text[a:b], a, size, config.tokenizer) if n > size else [(text[a:b], a, b, n, {"recursive_rule_level": -1, "recursive_rule_type": "endOfRules"})]
    return sorted(out, key=lambda c: c[1])


TABLE_START = re.compile("<table", re.I | re.A)
#: A to Z to lower case, all else as it is, so that places stay.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def parse_markdown(text: str) -> tuple | None:
    """(header, columns, row spans, footer) of the first table with rows: they reach from a separator line to the next blank line."""
    lines = text.split("\n")
    if not lines[-1]:
        lines.pop()
    starts: list[int] = []
    for i in range(1, len(lines)):
        if not is_separator(lines[i]):
            continue
        end = i + 1
        while end < len(lines) and lines[end].strip(SPACES):
            end += 1
        if end > i + 1:
            starts = starts or [*accumulate((len(line) + 1 for line in lines), initial=0)]
            starts[-1] = min(starts[-1], len(text))
            cells = trim(lines[i - 1]).removeprefix("|").removesuffix("|").split("|")
            return text[starts[i - 1] : starts[i + 1]], [c for c in map(trim, cells) if c], list(zip(starts[i + 1 : end], starts[i + 2 : end + 1])), ""
    return None


def parse_html(text: str) -> tuple | None:
    """(header, no columns, row spans, footer) of the first table element with rows: those of its first body, if it has one."""
    tags = text.lower() if text.isascii() else text.translate(LOWER)
    start = tags.find("<table")
    inner = tags.find(">", start) if start >= 0 else -1
    close = tags.find("</table>", inner) if inner >= 0 else -1
    if close < 0:
        return None
    begin, end = inner + 1, close
    body = tags.find("<tbody", begin, close)
    if body >= 0:
        opened = tags.find(">", body, close)
        if opened < 0:
            return None
        begin = opened + 1
        found = tags.find("</tbody>", begin, close)
        end = found if found >= 0 else close
    rows: list[tuple[int, int]] = []
    at = begin
    while (row := tags.find("<tr", at, end)) >= 0:
        opened = tags.find(">", row, end)
        last = tags.find("</tr>", opened, end) if opened >= 0 else -1
        if last < 0:
            break
        at = last + len("</tr>")
        rows.append((row, at))
    return (text[start : rows[0][0]], [], rows, text[rows[-1][1] : close + len("</table>")]) if rows else None


def table(text: str, config: TableConfig) -> list[Chunk]:
    """Groups of rows, each between the table's header and footer."""
    kind = config.format if config.format != "auto" else "html" if "<" in text and TABLE_START.search(text) else "markdown"
    parsed = parse_html(text) if kind == "html" else parse_markdown(text)
    if parsed is None:
        return []
    header, columns, rows, footer = parsed
    count = config.tokenizer.count_texts
    if config.mode == "row":
        groups = [(i, min(i + config.chunk_size, len(rows)), min(config.chunk_size, len(rows) - i)) for i in range(0, len(rows), config.chunk_size)]
    else:
        base = sum(count([header, footer] if footer else [header]))
        groups = token_groups(count([text[a:b] for a, b in rows]), base, config.chunk_size)
    about = {"is_table": True, "table_format": kind, "table_mode": config.mode, "table_has_header": bool(trim(header))}
    if columns:
        about["table_columns"] = columns
    out = []
    for first, end, tokens in groups:
        a, b = rows[first][0], rows[end - 1][1]
        own = text[a:b] if kind == "markdown" else "".join([text[i:j] for i, j in rows[first:end]])  # Markdown rows follow one another
        out.append((header + own + footer, a, b, tokens, {**about, "table_row_start": first, "table_row_end": end - 1, "table_row_count": end - first}))
    return out


def token_groups(sizes: list[int], base: int, most: int) -> list[tuple[int, int, int]]:
    """(first row, row behind the last, tokens) of groups that stay within ``most``, or hold one row; ``base`` counts in each."""
    out, first, used = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and base + used + n > most:
            out.append((first, i, base + used))
            first, used = i, 0
        used += n
    return [*out, (first, len(sizes), base + used)]


def markdown_tables(text: str) -> Iterator[tuple[int, int]]:
    """Spans of whole tables, without the last line's end: a pipe line, a separator line, and the pipe lines that follow."""
    if "---" not in text:
        return
    lines, at = text.split("\n"), 0
    starts = [0, *accumulate([len(line) + 1 for line in lines])]
    while at + 1 < len(lines):
        if not ("|" in lines[at] and is_pipe(lines[at]) and is_separator(lines[at + 1])):
            at += 1
            continue
        end = at + 2
        while end < len(lines) and is_pipe(lines[end]):
            end += 1
        yield starts[at], starts[end] - 1
        at = end


def markdown_segments(text: str) -> list[tuple[str, str]]:
    """(kind, text): tables and the prose between, blank ones left out; the line end between them belongs to the table."""
    found = list(markdown_tables(text))
    gaps = zip([0, *(b + 1 for _, b in found)], [*(a - 1 for a, _ in found), len(text)])
    prose = [("text", text[a : max(a, b)]) for a, b in gaps]
    tables = [("table", text[a:b] + "\n") for a, b in found]
    mixed = [x for pair in zip(prose, [*tables, ("text", "")]) for x in pair]
    return [(kind, part) for kind, part in mixed if trim(part)]
