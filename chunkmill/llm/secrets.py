"""Secret scans with a trigram inverted index, in DataFrame operations only.

From each rule's expression a Boolean trigram query is derived: alternatives of mandatory trigrams. The index
holds postings (trigram, document) of the trigrams that the rules name, over all whole texts in lower case.
Per rule and alternative the postings are intersected: a document is a candidate if it is posted under each of
the alternative's trigrams. Candidates are verified with the expression itself; a rule without mandatory
trigrams (a run of hexadecimal digits) is run on every text.

Positions are code points, from the lengths of the matches and of the gaps between them. All work on a text
stays in its row: the number of matches bounds it, not the size of any group.

Nulls: a null text counts as empty and has no spans; a null identifier is a value of its own. Rows that share an
identifier share candidates, and each is verified by its own text. An empty table gives an empty result. Other
columns play no part.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of
from .trigrams import trigram_query


class Rule(NamedTuple):
    name: str
    pattern: str
    #: Of a match's text (or of its group), the least length; group 0 is the whole match.
    least: int = 1
    group: int = 0
    base: bool = False
    #: Names in the pattern whose letters stand in either case.
    any_case: str = ""
    #: What the main scan runs instead, where that finds the same spans at less cost.
    scan: str = ""


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, "password|passwd|secret|token|api_?key"),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True, scan=r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
#: Matches of a text that one inner array gathers.
INNER = 256
SPANS = "array<struct<start:int,stop:int>>"


def expression(rule: Rule) -> str:
    found = rule.scan or rule.pattern
    return found.replace(rule.any_case, f"(?i:{rule.any_case})", 1) if rule.any_case else found


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in the text, as an array of (start, stop)."""
    found = F.lit(expression(rule))
    hits, gaps = F.regexp_extract_all(text, found, F.lit(0)), F.split(text, expression(rule), -1)
    value = F.regexp_extract_all(text, found, F.lit(rule.group))
    lengths = lambda a: F.transform(a, F.length)
    steps = F.arrays_zip(lengths(F.slice(gaps, 1, F.size(hits))).alias("gap"), lengths(hits).alias("hit"), lengths(value).alias("value"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        own = F.when(x["value"] >= rule.least, F.array(F.struct(start.alias("start"), (start + x["hit"]).alias("stop")))).otherwise(F.array().cast(SPANS))
        return F.struct((start + x["hit"]).alias("at"), F.concat(state["spans"], own).alias("spans"))

    def many(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast(SPANS).alias("spans")), step)
        return F.struct(inner["at"].alias("at"), F.concat(state["spans"], F.array(inner["spans"])).alias("spans"))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / INNER).cast("int")), lambda i: F.slice(steps, i * INNER + 1, INNER))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("spans"))
    return F.when(F.rlike(text, found), F.flatten(F.aggregate(parts, start, many)["spans"])).otherwise(F.array().cast(SPANS))


def postings(keyed: DataFrame, wanted: list[str]) -> DataFrame:
    """(trigram, _key) of the wanted trigrams, folded to lower case."""
    folded = keyed.select("_key", F.lower("_text").alias("_folded"))
    held = F.array(*[F.when(F.contains("_folded", F.lit(t)), F.lit(t)) for t in wanted])
    return folded.select("_key", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(spark: SparkSession, keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_key, _rules): for each document the rules whose query its postings satisfy."""
    terms = [(r.name, i, t, len(need)) for r in rules for i, need in enumerate(trigram_query(r.pattern) or []) for t in sorted(need)]
    queries = spark.createDataFrame(terms, "rule string, alternative int, trigram string, need int")
    found = postings(keyed, sorted({t for _, _, t, _ in terms})).join(F.broadcast(queries), "trigram")  # as long as the rules
    met = found.groupBy("_key", "rule", "alternative", "need").agg(F.count_distinct("trigram").alias("n")).filter("n = need")
    return met.groupBy("_key").agg(F.collect_set("rule").alias("_rules"))


def of_kind(kind: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop"))


def is_kind(kind: int):
    return lambda x: x["kind"] == kind


def find_secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, ``found``, an array of (start, kind, stop) by start, then kind as listed."""
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"), text_of(text_col).alias("_text"))
    indexed = tuple(r for r in rules if trigram_query(r.pattern) is not None)
    at = keyed.join(candidates(spark, keyed, indexed), "_key", "left")
    for i, r in enumerate(rules):
        spans = spans_of(F.col("_text"), r)
        if r in indexed:
            spans = F.when(F.array_contains("_rules", r.name), spans).otherwise(F.array().cast(SPANS))
        at = at.withColumn(f"_s{i}", F.transform(spans, of_kind(i)))
    found = F.array_sort(F.concat(*[F.col(f"_s{i}") for i in range(len(rules))]))
    return at.select(F.col("_id").alias(id_col), found.alias("found"))


def secret_report(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans as ``kind:start:end``."""
    base = [i for i, r in enumerate(rules) if r.base]
    names = F.array(*[F.lit(r.name) for r in rules])
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["stop"])), ",")
    own = F.filter("found", lambda x: x["kind"].isin(base))
    counts = [F.size(F.filter("found", is_kind(i))).cast("long").alias(f"n_{rules[i].name}") for i in base]
    return find_secrets(spark, docs, id_col, text_col, rules).select(id_col, *counts, F.sha2(written(own), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
