"""Text functions on columns. White space and lengths follow JavaScript: its class of space characters, UTF-16 units."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that JavaScript's trim and \s take as white space.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACES = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
LINE_ENDS = r"\n\r\u2028\u2029"
#: MIME types by extension; accepted types and extensions; limits.
MIME_TYPES = {".pdf": "application/pdf", ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv"}
DEFAULT_MIME = "application/octet-stream"
MAX_FILE_BYTES = 100 * 1024 * 1024
PART_BYTES = 512 * 1024
FAST_THRESHOLD = 100_000
PREVIEW_CHARS = 180

#: One cell of a Markdown separator line.
CELL = r":?-{3,}:?"


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(~F.rlike(text, F.lit(rf"[^{JS_SPACE}]")), F.lit(True))


def normalize_whitespace(text: Column) -> Column:
    """CRLF to LF; tabs and the like to a space; runs of spaces to one, both at once; three or more LF to two; trim."""
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    for pattern, put in ((r"(?:[\t\f\x0B]| (?=[\t\f\x0B ]))[\t\f\x0B ]*+", " "), (r"\n\n\n++", "\n\n")):
        text = F.regexp_replace(text, pattern, put)
    return js_trim(text)


def utf16_length(text: Column) -> Column:
    """ASCII texts need no encoding to tell."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1)).cast("int")


def delimiter_pattern(delimiters: Sequence[str]) -> str:
    """Alternatives longest first, the order of equals kept. The characters that get a backslash."""
    return "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", d) for d in sorted(delimiters, key=len, reverse=True))


def delimiter_matches(text: Column, delimiters: Sequence[str]) -> Column:
    """The delimiters found, left to right, without overlap."""
    return F.regexp_extract_all(text, F.lit(delimiter_pattern(delimiters)), F.lit(0))


def split_by_delimiters(text: Column, delimiters: Sequence[str], include: str | None = "prev") -> Column:
    """Parts with the delimiter at the end of the part before (prev), at the start of the next (next) or dropped (None); no empty parts."""
    found = delimiter_matches(text, delimiters)
    gaps = F.split(text, delimiter_pattern(delimiters), -1)
    none = F.array().cast("array<string>")
    if include == "prev":
        parts = F.zip_with(gaps, F.concat(found, F.array(F.lit(""))), lambda g, d: F.concat(g, d))
    elif include == "next":
        parts = F.zip_with(F.concat(F.array(F.lit("")), found), gaps, lambda d, g: F.concat(d, g))
    else:
        parts = gaps
    return F.coalesce(F.filter(parts, lambda p: p != ""), none)


def split_lines(text: Column) -> Column:
    """Lines with their line end, no empty last one."""
    return F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


#: Numbers that one inner array of a running sum gathers.
INNER = 256


def starts_of(values: Column) -> Column:
    """Of whole numbers the sum of those before each: in arrays of ``INNER``, so that no long array is built up item by item. The numbers are bound once."""

    def one(state: Column, n: Column) -> Column:
        return F.struct((state["at"] + n).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def many(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast("array<int>").alias("out")), one)
        return F.struct(inner["at"].alias("at"), F.concat(state["out"], F.array(inner["out"])).alias("out"))

    def summed(steps: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / INNER).cast("int")), lambda i: F.slice(steps, i * INNER + 1, INNER))
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")), many)["out"])

    return F.element_at(F.transform(F.array(values), lambda steps: F.when(F.size(steps) > 0, summed(steps)).otherwise(F.array().cast("array<int>"))), 1)


def with_offsets(parts: Column) -> Column:
    """Parts to structs (text, start_idx, end_idx) that follow one another, in UTF-16 units."""
    sized = F.transform(parts, lambda p: F.struct(p.alias("text"), utf16_length(p).alias("n")))
    placed = lambda s: F.zip_with(s, starts_of(F.transform(s, lambda x: x["n"])), lambda x, at: F.struct(x["text"].alias("text"), at.alias("start_idx"), (at + x["n"]).alias("end_idx")))
    return F.element_at(F.transform(F.array(sized), placed), 1)


def file_extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise("")


def mime_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, file_extension(name)), F.lit(DEFAULT_MIME))


def looks_like_markdown_table(text: Column) -> Column:
    """Some pipe line and some separator line. The latter's cells may stand on several lines, which matters only for two of one cell each."""
    lines = F.split(text, f"[{LINE_ENDS}]", -1)
    space, inside = f"[{JS_SPACE}]*+", f"(?:(?![{LINE_ENDS}])[{JS_SPACE}])*+"
    cell = CELL.replace("}", "}+")
    broken = rf"(?:\A|[{LINE_ENDS}]){inside}(?:\|{space})?+{cell}{space}\|{space}{cell}{inside}(?:\|{inside})?+(?:\z|[{LINE_ENDS}])"
    return F.exists(lines, is_pipe_line) & (F.exists(lines, is_separator_line) | F.rlike(text, F.lit(broken)))


def is_pipe_line(line: Column) -> Column:
    own = js_trim(line)
    return F.startswith(own, F.lit("|")) & F.endswith(own, F.lit("|")) & (F.length(own) > 1) & ~F.rlike(own, F.lit(f"[{LINE_ENDS}]"))


def is_separator_line(line: Column) -> Column:
    """Two cells of dashes at least, whose pipes may enclose the line. Cells are looked at one by one, so that a line costs no more than its length."""
    inner = F.regexp_replace(F.regexp_replace(js_trim(line), r"^\|", ""), r"\|\z", "")
    return F.contains(line, F.lit("---")) & (F.size(F.split(inner, r"\|", 3)) > 1) & F.forall(F.split(inner, r"\|", -1), lambda c: F.rlike(js_trim(c), F.lit(rf"\A{CELL}\z")))


def strategy(name: Column, text: Column, fast_threshold: int = FAST_THRESHOLD) -> Column:
    """csv: token; md: table or recursive; pdf and txt: fast if long, else sentence; others null."""
    return strategy_of(file_extension(name), text, fast_threshold)


def strategy_of(ext: Column, text: Column, fast_threshold: int = FAST_THRESHOLD) -> Column:
    long = F.when(utf16_length(text) >= fast_threshold, "fast").otherwise("sentence")
    return F.when(ext == ".csv", "token").when(ext == ".md", F.when(looks_like_markdown_table(text), "table").otherwise("recursive")).when(ext.isin(".pdf", ".txt"), long)


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def record_id(file_id: Column, index: Column) -> Column:
    return F.concat_ws("-", file_id, index.cast("string"))


def tool_arguments(text: Column) -> Column:
    """Accumulated arguments as a map; blank or invalid text gives an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(F.nullif(js_trim(text), F.lit("")), "map<string,string>"), empty)


def header_cells(line: Column) -> Column:
    """Cells of a Markdown header line."""
    inner = F.regexp_replace(F.regexp_replace(js_trim(line), r"^\|", ""), r"\|\z", "")
    return F.filter(F.transform(F.split(inner, r"\|", -1), js_trim), lambda x: x != "")


def contains_or_all(column: Column, wanted: str | None) -> Column:
    """Substring predicate; no or empty text means no filter."""
    return F.contains(column, F.lit(wanted)) if wanted else F.lit(True)
