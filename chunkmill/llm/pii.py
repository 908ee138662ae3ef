"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans come from four expressions and their checks and always stay. The method adds candidates that the base
expressions cannot reach: e-mail addresses written out ("name at host dot org"), phone numbers without a plus,
national identity numbers, and names behind a title. On every span, base or candidate, labelers vote yes, no or nothing:

* regex labelers: the strict and the loose shape of the kind, and its check (digit counts, number ranges);
* gazetteers: top-level domains, given names, country and issuer numbers, words that ask for the kind (call, mail, card);
* context labelers: words around the span that speak for or against it (version, page, price), and what stands next to it.

Everything is learnt from all spans of the corpus, in grouped sums that Spark combines before the shuffle:

1. The votes are counted by pattern (at most 3^6 a kind). Expectation-maximisation over those counts estimates, without
   labels, each labeler's share of right votes and the posterior of each pattern.
2. The span classifier, a naive Bayes over the votes, the span's shape and length and the words around it (``FEATURES``
   hashed places a kind), is trained on those posteriors by summing them per place.
3. A logistic curve from the classifier's score to the posteriors, fitted on the sums per ``STEP`` of score, calibrates it.

A candidate is added if the classifier gives it ``THRESHOLD`` or more. Sums are of whole numbers, so reruns agree.
Only the pattern counts and the sums, of fixed size, reach the driver.

All scans are linear in the text's length: expressions start at their rarest part, numbers are cut in one pass, overlaps
are looked up in sorted spans, and context is counted in words, found once a text.

Nulls: a null text counts as empty and has no spans. Repeated rows each get a row. A very long text is held once. An empty
table gives an empty result. Other columns play no part, whatever their names. Without candidates nothing is trained and
only base spans come out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_table, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("written_email", "local_phone", "identity", "person")
KINDS = BASE + ADDED
THRESHOLD, ROUNDS, PRIOR = 0.9, 40, 0.5
#: Hashed places of the classifier, and parts of a posterior's whole number.
FEATURES, WHOLE = 4096, 1 << 20
#: Steps of the score for the calibration, and the largest score.
STEP, MOST = 0.5, 40.0

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")

AT = re.compile(r" ?(?:\(at\)|\[at\]) ?| at ")
HOST = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z0-9-]++| dot [A-Za-z0-9-]++)+")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?0?[0-9]{2,4}\)?[ /-][0-9]{3,4}[ -][0-9]{3,4}(?![0-9.-])")
IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Don", "Doña", "Monsieur", "Madame", "Mademoiselle", "Sir", "Lady")
PERSON = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? (?:[A-Z][a-zà-ÿ]+)(?: [A-Z][a-zà-ÿ]+)?")

#: Fixed word lists of the gazetteers, of common knowledge: top-level domains, calling codes, and given names that are
#: frequent in English, German, French and Spanish. ``detect`` takes longer ones as a parameter.
TOP_LEVEL = "com org net edu gov mil int info biz name pro io ai app dev co me tv de at ch li fr be lu nl es pt it uk ie us ca mx ar br cl pe ve au nz jp cn in kr ru ua pl cz sk hu ro bg gr tr se no dk fi is ee lv lt hr si rs il za eu"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 359 370 371 372 380 385 386 420 421"
GIVEN_NAMES = (
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew george kevin brian edward jason jeffrey ryan jacob gary eric stephen larry scott mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty sandra margaret ashley kimberly emily donna michelle carol amanda melissa deborah emma olivia sophia "
    "hans peter wolfgang klaus jürgen dieter manfred uwe stefan andreas christian martin frank jens julia anna sabine monika petra ursula renate heike claudia katharina lena "
    "jean pierre michel andré philippe alain bernard jacques françois laurent nicolas julien marie nathalie isabelle sylvie catherine françoise monique camille chloé luc sophie "
    "josé antonio manuel francisco juan pedro jesús carlos miguel luis javier maría carmen ana isabel dolores pilar josefa rosa lucía jose maria jesus"
)
GAZETTEERS = {"domains": frozenset(TOP_LEVEL.split()), "calling": frozenset(CALLING.split()), "names": frozenset(GIVEN_NAMES.split())}
ASKS = {
    "email": frozenset("mail email e-mail contact write correo courriel".split()),
    "ip": frozenset("ip host server address login adresse dirección".split()),
    "card": frozenset("card visa mastercard amex credit debit pay karte tarjeta carte".split()),
    "phone": frozenset("call phone tel telephone mobile fax telefon teléfono téléphone".split()),
    "identity": frozenset("ssn social security identity id number ausweis".split()),
    "person": frozenset("dear contact by from signed name".split()),
}
ASKS |= {"written_email": ASKS["email"], "local_phone": ASKS["phone"]}
AGAINST = frozenset("version page chapter price figure table isbn order total line section row column".split())
LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
TOKEN = re.compile(r"\S+")
#: Words of context before and after a span.
BEFORE, AFTER = 5, 3
LABELERS = ("shape", "check", "gazetteer", "asked", "against", "apart")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:  # the expression itself would start at every letter of a long word
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            found.append((0, start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if not DIGIT.search(text):
        return found
    if "." in text:
        for m in DOTTED.finditer(text):  # in a run of numbers and dots, each four in turn
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                own = parts[i : i + 4]
                end = at + sum(map(len, own)) + 3
                if all(map(octet, own)):
                    found.append((1, at, end))
                at = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = digits_of(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


def written_emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, m.end())
        done = m.end()
        if host and m.start() - start > 1:
            yield start, host.end()
            done = host.end()


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the added kinds that overlap no base span, by kind, then start."""
    found = []
    numbers = DIGIT.search(text) is not None
    if "dot" in text:
        found += [(4, a, b) for a, b in written_emails(text)]
    if numbers:
        found += [(5, *m.span()) for m in LOCAL_PHONE.finditer(text)]
        found += [(6, *m.span()) for m in IDENTITY.finditer(text)]
    if any(t in text for t in TITLES):
        found += [(7, *m.span()) for m in PERSON.finditer(text)]
    if not found or not base:
        return found
    starts, ends, most = [], [], 0
    for a, b in sorted((a, b) for _, a, b in base):
        most = max(most, b)
        starts.append(a)
        ends.append(most)  # of all spans up to here
    left = lambda a, b: (i := bisect_left(starts, b)) == 0 or ends[i - 1] <= a
    return [(k, a, b) for k, a, b in found if left(a, b)]


class Context:
    """The words around spans of one text."""

    def __init__(self, text: str):
        self.text = text
        self.at = [m.span() for m in TOKEN.finditer(text)]
        self.starts = [a for a, _ in self.at]

    def around(self, start: int, end: int) -> tuple[list[str], list[str]]:
        i, j = bisect_left(self.starts, start), bisect_left(self.starts, end)
        words = lambda spans: [w.lower() for a, b in spans for w in LETTERS.findall(self.text[a:b])]
        return words([(a, min(b, start)) for a, b in self.at[max(0, i - BEFORE) : i]])[-BEFORE:], words(self.at[j : j + AFTER])[:AFTER]


def votes(kind: str, span: str, before: list[str], after: list[str], left: str, right: str, gazetteers: dict[str, frozenset]) -> tuple[int, ...]:
    """One vote per labeler: 1 for, -1 against, 0 none. ``left`` and ``right`` are the characters next to the span."""
    words = [w.lower() for w in LETTERS.findall(span)]
    digits = digits_of(span)
    shape, check = 0, 1
    if kind in ("email", "written_email"):
        domain = words[-1] if words else ""
        gazetteer = 1 if domain in gazetteers["domains"] else -1
        if kind == "email":
            shape, check = (1 if len(domain) >= 2 and span[-1:].isalpha() else -1), (-1 if ".." in span or span[0] in ".%+-" else 1)
        else:
            shape, check = (1 if "(" in span or "[" in span else 0), (1 if len(words) >= 4 else -1)
    elif kind == "ip":
        parts = span.split(".")
        shape, gazetteer = (1 if all(str(int(p)) == p for p in parts if len(p) <= 3) and max(map(len, parts)) <= 3 else -1), (-1 if not parts[0].strip("0") else 0)
    elif kind == "card":
        shape, gazetteer = (1 if re.fullmatch(r"[0-9]+|[0-9]{4}([ -][0-9]{4})+([ -][0-9]{1,3})?", span) else -1), (1 if digits[0] in "3456" else -1)
    elif kind == "phone":
        shape, gazetteer = (1 if " " in span or "-" in span else 0), (1 if any(digits[:n] in gazetteers["calling"] for n in (1, 2, 3)) else -1)
    elif kind == "local_phone":
        shape, check = (1 if span[0] == "(" else 0), (1 if 9 <= len(digits) <= 12 else -1)
        gazetteer = -1 if len(set(digits)) < 4 else 0
    elif kind == "identity":
        check = 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
        gazetteer = -1 if len(set(digits)) < 3 else 0
    else:
        shape, check = (1 if len(words) > 2 else 0), (1 if all(len(w) > 1 for w in words[1:]) else -1)
        gazetteer = 1 if any(w in gazetteers["names"] for w in words[1:]) else -1
    asked, against = (1 if ASKS[kind].intersection(before) else 0), (-1 if AGAINST.intersection(before) or AGAINST.intersection(after) else 0)
    apart = 0 if left in " \n(:,;" and right in " \n).,:;" else -1
    return shape, check, gazetteer, asked, against, apart


def places(vote: tuple[int, ...], span: str, before: list[str], after: list[str]) -> list[int]:
    """Hashed places of a span's features: its votes, shape, length, and the words around it."""
    shape = re.sub("[0-9]+", "0", re.sub(r"[^\W\d_]+", lambda m: "Aa" if m[0][0].isupper() else "a", span)) if len(span) <= 256 else "long"
    told = [*(f"v{i}{v}" for i, v in enumerate(vote)), f"s{shape}", f"n{len(span).bit_length()}", *{f"b{w}" for w in before}, *{f"a{w}" for w in after}]
    return [zlib.crc32(x.encode()) % FEATURES for x in told]


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("votes", pa.int32()), ("places", pa.list_(pa.int32()))])
FOUND = "id long, spans array<struct<kind:int,start:int,stop:int,votes:int,places:array<int>>>"


def read_text(text: str, gazetteers: dict[str, frozenset]) -> list[dict]:
    base = base_spans(text)
    rows = base + candidate_spans(text, base)
    context, out = Context(text) if rows else None, []
    for k, a, b in rows:
        before, after = context.around(a, b)
        span = text[a:b]
        vote = votes(KINDS[k], span, before, after, text[a - 1] if a else " ", text[b] if b < len(text) else " ", gazetteers)
        code = 0
        for v in vote:
            code = code * 3 + v + 1
        out.append({"kind": k, "start": a, "stop": b, "votes": code, "places": places(vote, span, before, after)})
    return out


def finder(gazetteers: dict[str, frozenset]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [read_text(text.as_py(), gazetteers) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], names=["id", "spans"])

    return run


def decoded(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (len(LABELERS) - 1 - i) % 3 - 1 for i in range(len(LABELERS))], axis=1)


def reliabilities(vote: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over pattern counts: each labeler's share of right votes where it votes, and the posterior of each pattern.

    A labeler has its own odds of voting yes, no or nothing for true and for false spans, so one that says the same of all
    tells nothing. No vote counts against what it says: labelers are better than chance.
    """
    cast = np.stack([vote == v for v in (-1, 0, 1)], axis=2).astype(float)
    prior = {1: np.array([1.0, 2.0, 3.0]), 0: np.array([3.0, 2.0, 1.0])}
    p = 1 / (1 + np.exp(-vote.sum(axis=1)))
    for _ in range(ROUNDS):
        share = float(np.clip((p @ n + PRIOR * 2) / (n.sum() + 2), 0.05, 0.95))
        odds = []
        for y, weight in ((1, p * n), (0, (1 - p) * n)):
            met = np.einsum("p,plv->lv", weight, cast) + prior[y]
            odds.append(np.log(met / met.sum(axis=1, keepdims=True)))
        tells = odds[0] - odds[1]
        tells[:, 0], tells[:, 2] = np.minimum(tells[:, 0], 0), np.maximum(tells[:, 2], 0)
        p = 1 / (1 + np.exp(-np.clip(np.einsum("plv,lv->p", cast, tells) + np.log(share / (1 - share)), -30, 30)))
    right = np.where(vote > 0, p[:, None], 1 - p[:, None]) * (vote != 0) * n[:, None]
    return (right.sum(axis=0) + 1) / (((vote != 0) * n[:, None]).sum(axis=0) + 2), p


def posteriors(patterns: list[tuple[int, int, int]]) -> dict[int, dict[int, int]]:
    """Counts of (kind, votes) to the posterior of each, in parts of ``WHOLE``."""
    out: dict[int, dict[int, int]] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = sorted((c, n) for k, c, n in patterns if k == kind)
        codes, n = np.array([c for c, _ in rows]), np.array([x for _, x in rows], float)
        _, p = reliabilities(decoded(codes), n)
        out[kind] = dict(zip(codes.tolist(), np.rint(p * WHOLE).astype(int).tolist()))
    return out


def spread(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes, span of each place, places) of all spans of a batch."""
    flat = spans.flatten()
    listed = flat.field("places")
    ends = listed.offsets.to_numpy()
    return flat.field("kind").to_numpy(), flat.field("votes").to_numpy(), np.repeat(np.arange(len(flat)), np.diff(ends)), listed.flatten().to_numpy()


def told(kind: np.ndarray, votes: np.ndarray, known: dict[int, dict[int, int]]) -> np.ndarray:
    return np.array([known[k][v] for k, v in zip(kind.tolist(), votes.tolist())], np.int64)


def sums_of(found: DataFrame, part, size: int) -> np.ndarray:
    """Sums over all spans of whole numbers (yes, all) by kind and place; ``part`` adds a batch's to an array (kinds, size, 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(KINDS), size, 2), np.int64)
        for batch in batches:
            part(sums, batch.column(0))
        kind, place = np.nonzero(sums[:, :, 1])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(place), pa.array(sums[kind, place, 0]), pa.array(sums[kind, place, 1])], names=["kind", "place", "yes", "n"])

    out = np.zeros((len(KINDS), size, 2))
    rows = found.select("spans").mapInArrow(run, "kind long, place long, yes long, n long").groupBy("kind", "place").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n"))
    for r in rows.collect():  # kinds x size rows at most
        out[r["kind"], r["place"]] = r["yes"], r["n"]
    return out / WHOLE


class SpanClassifier:
    """Naive Bayes over the places, with its scores calibrated to the posteriors."""

    def __init__(self, place_sums: np.ndarray):
        yes, no = place_sums[:, :, 0], place_sums[:, :, 1] - place_sums[:, :, 0]
        share = lambda x: np.log((x + 0.5) / (x.sum(axis=1, keepdims=True) + 0.5 * FEATURES))
        self.weights = share(yes) - share(no)
        self.bias = np.log((yes.sum(axis=1) + 1) / (no.sum(axis=1) + 1))
        self.slope, self.shift = np.ones(len(KINDS)), np.zeros(len(KINDS))

    def score(self, spans: pa.ListArray) -> np.ndarray:
        kind, _, of, place = spread(spans)
        found = self.bias[kind] + np.bincount(of, self.weights[kind[of], place], len(kind))
        return np.clip(np.round(found, 6), -MOST, MOST)

    def step(self, spans: pa.ListArray) -> np.ndarray:
        return np.rint((self.score(spans) + MOST) / STEP).astype(np.int64)

    def calibrate(self, step_sums: np.ndarray, rounds: int = 60) -> None:
        """A rising logistic curve per kind, by Newton's steps on the sums per step of score."""
        x = np.stack([np.arange(step_sums.shape[1]) * STEP - MOST, np.ones(step_sums.shape[1])], axis=1)
        for k, own in enumerate(step_sums):
            if not own[:, 1].any():
                continue
            w = np.array([0.5, 0.0])
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
                gradient = x.T @ (p * own[:, 1] - own[:, 0]) + 1e-2 * (w - [0.5, 0.0])
                h = x.T @ (x * (p * (1 - p) * own[:, 1])[:, None]) + 1e-2 * np.eye(2)
                change = np.linalg.solve(h, gradient)
                w = w - change * min(1.0, 0.5 / max(abs(change[0]), 1e-9))
            self.slope[k], self.shift[k] = max(w[0], 0.01), w[1]

    def probability(self, spans: pa.ListArray) -> np.ndarray:
        kind = spans.flatten().field("kind").to_numpy()
        return 1 / (1 + np.exp(-np.clip(self.score(spans) * self.slope[kind] + self.shift[kind], -50, 50)))


def train(found: DataFrame) -> SpanClassifier | None:
    """EM over the vote patterns, the classifier on its posteriors, its calibration; None without spans."""
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count().collect()  # 8 kinds of 3^6 patterns at most
    if not counted:
        return None
    known = posteriors([tuple(r) for r in counted])

    def by_place(sums: np.ndarray, spans: pa.ListArray) -> None:
        kind, votes_, of, place = spread(spans)
        np.add.at(sums, (kind[of], place), np.stack([told(kind, votes_, known)[of], np.full(len(of), WHOLE)], axis=1))

    model = SpanClassifier(sums_of(found, by_place, FEATURES))

    def by_step(sums: np.ndarray, spans: pa.ListArray) -> None:
        kind, votes_, _, _ = spread(spans)
        np.add.at(sums, (kind, model.step(spans)), np.stack([told(kind, votes_, known), np.full(len(kind), WHOLE)], axis=1))

    model.calibrate(sums_of(found, by_step, int(2 * MOST / STEP) + 1))
    return model


def detect(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gazetteers: dict[str, frozenset] = GAZETTEERS) -> DataFrame:
    """One row per input row: id and ``spans`` (kind as in ``KINDS``, start, stop, the classifier's score), base and added, by kind, then start."""
    made = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("body")).mapInArrow(finder(gazetteers), FOUND)
    found = stage_table(spark, made, "pii-spans")
    model = train(found)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(1)
            scores = [] if model is None else np.round(model.probability(spans), 6).tolist()
            rows, at = [], 0
            for each in spans.to_pylist():
                own = [{"kind": s["kind"], "start": s["start"], "stop": s["stop"], "score": p} for s, p in zip(each, scores[at : at + len(each)])]
                rows.append([s for s in own if s["kind"] < len(BASE) or s["score"] >= THRESHOLD])
                at += len(each)
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["id", "spans"])

    return found.mapInArrow(keep, "id long, spans array<struct<kind:int,start:int,stop:int,score:double>>").withColumnRenamed("id", id_col)


def pii_report(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans as ``kind:start:end``."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, told = [], [], []
            for spans in batch.column(1).to_pylist():
                rows = [f"{KINDS[s['kind']]}:{s['start']}:{s['stop']}" for s in spans]
                own = [s["kind"] for s in spans if s["kind"] < len(BASE)]
                counts.append([own.count(k) for k in range(len(BASE))])
                sums.append(hashlib.sha256(",".join(rows[: len(own)]).encode()).hexdigest())
                told.append(",".join(rows))
            n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, pa.array(sums, pa.string()), pa.array(told, pa.string())], names=["id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    return detect(spark, docs, id_col, text_col).withColumnRenamed(id_col, "id").mapInArrow(digests, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("id", id_col)
