"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns (email, ip, card, phone) are searched in whole texts, each in one pass. The field works on the regions
around digits, "@" and written-out addresses: a segment of up to MAX_TOKENS tokens that may be an entity is scored as a
whole (digit counts and groups, check digit, octets, separators, neighbours, words before it), and dynamic programming
over all segmentations of the region chooses boundaries and types together. Its spans are added where they meet no
span of the patterns. It is trained here by gradient on the likelihood of labelled sentences that `examples` makes from
a fixed seed: true entities in forms that the patterns miss, and numbers that are none (dates, prices, versions, keys,
account numbers without a check digit).

Nulls: a null text is empty, a null id is kept. Repeated rows each get a row. An empty table gives an empty result.
Other columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import text_slices

KINDS = ("email", "ip", "card", "phone")
#: Of a numeric segment. Addresses may have more: three-label hosts that are written out with blanks and brackets have 30.
MAX_TOKENS = 16
ADDRESS_TOKENS = 48
#: Characters on both sides of a trigger that belong to its region, which reaches on to the end of an address there.
REACH = 28

# Fixed patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of the four patterns, by start, then kind. Every pattern reads the text once, whatever is in it."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at and at >= end else None
        if m:
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = len(".".join(four))
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                found.append(("ip", at, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# The field.
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_TRIGGER = re.compile(r"[0-9@]+|[\[(]\s?at\s?[\])]|(?<=\s)at(?=\s[A-Za-z0-9-]+\sdot\s)|\bat\b(?=.{1,20}\bdot\b)", re.I)
#: What a text without digits and "@" must have to be looked at: a trigger, seen without its details.
_MAY_TRIGGER = r"(?i)[\[(]\s?at\s?[\])]|\bat\b"
_AT = re.compile(r"@|[\[(]\s?at\s?[\])]|\sat\s", re.I)
_ADDRESS = re.compile(
    r"[A-Za-z0-9._%+-]+(\s?(@|[\[(]\s?at\s?[\])])\s?[A-Za-z0-9-]+((\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[A-Za-z0-9-]+)+|\sat\s[A-Za-z0-9-]+(\sdot\s[A-Za-z0-9-]+)+)", re.I
)
_HOST = re.compile(r"\s?[A-Za-z0-9-]+((\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[A-Za-z0-9-]+)+", re.I)
_WRITTEN = re.compile(r"[\[(]\s?(at|dot)\s?[\])]|\bat\b.*\bdot\b", re.I | re.S)
_OCTETS = re.compile(r"([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})")
_NORTH = re.compile(r"(\+?1[ .-]?)?(\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}")
_ABROAD = re.compile(r"(\+|00)[0-9]{1,3}([ .-]?\(?[0-9]{1,4}\)?){2,5}")
_DATE = re.compile(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}")
_FOURS = re.compile(r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[0-9]{3}([ .-])[0-9]{6}\2[0-9]{5}")
_NUMERIC = re.compile(r"[0-9+().\x20/-]+")
#: Words that announce an entity.
_CUES = {"email": re.compile(r"mail|contact|write", re.I), "ip": re.compile(r"\bip\b|server|host|address", re.I), "card": re.compile(r"card|visa|credit|pay", re.I), "phone": re.compile(r"phone|\btel|call|fax|mobile", re.I)}
FEATURES = 40


def regions(text: str, triggers) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for m in triggers:
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if not m[0].isdigit():
            # a local part longer than REACH, and a host to its last label
            first = m.start() - (m.start() > 0 and text[m.start() - 1].isspace())
            while first > 0 and text[first - 1] in _LOCAL:
                first -= 1
            tail = _HOST.match(text, m.end())
            lo, hi = min(lo, first), max(hi, tail.end() if tail else 0)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def candidates(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Token boundaries of a region, and the segments (first, end token) that could be an entity at all."""
    cuts = [m.start() for m in _TOKEN.finditer(text, lo, hi)] + [hi]
    digits = np.concatenate([[0], np.cumsum([sum(c.isdigit() for c in text[a:b]) for a, b in zip(cuts, cuts[1:])])])
    out = []
    n = len(cuts) - 1
    for i in range(n):
        a = text[cuts[i]]
        if not (a.isascii() and (a.isalnum() or a in "+(")):
            continue
        for j in range(i + 1, min(n, i + (ADDRESS_TOKENS if a not in "+(" and _AT.search(text, cuts[i], cuts[min(n, i + ADDRESS_TOKENS)]) else MAX_TOKENS)) + 1):
            z = text[cuts[j] - 1]
            if not (z.isascii() and z.isalnum()):
                continue
            some = int(digits[j] - digits[i])
            s = text[cuts[i] : cuts[j]]
            numeric = j - i <= MAX_TOKENS and 4 <= some <= 24 and not z.isalpha() and _NUMERIC.fullmatch(s)
            if numeric or (_AT.search(s) and a not in "+(" and _ADDRESS.fullmatch(s)):
                out.append((i, j))
    return cuts, out


def features(text: str, start: int, end: int) -> list[int]:
    """The numbers of the features that hold for a whole span."""
    s = text[start:end]
    digits = "".join(_DIGITS.findall(s))
    n = len(digits)
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    out = [0, 1 + next((k for k, most in enumerate((6, 9, 10, 12, 13, 15, 16, 19)) if n <= most), 8)]
    octets = _OCTETS.fullmatch(s)
    checks = [
        n >= 13 and luhn(digits), s[0] == "+", s[0] == "(", bool(_ADDRESS.fullmatch(s)), bool(_WRITTEN.search(s)), bool(octets), bool(octets and all(int(x) <= 255 for x in octets.groups())),
        bool(_NORTH.fullmatch(s)), bool(_ABROAD.fullmatch(s)), bool(_DATE.fullmatch(s)), bool(_FOURS.fullmatch(s)), s.isdigit(), " " in s, "-" in s, "." in s, "(" in s, any(c.isalpha() for c in s),
        left.isalnum(), right.isalnum(), left in tuple(".-+/,_=#$"), right in tuple("-/_=") or bool(re.match(r"[.,][0-9]", text[end : end + 2])), left in tuple("\"'"), s.count("(") != s.count(")"), n >= 13 and not luhn(digits), left == " " and text[start - 2 : start - 1].isdigit(), right == " " and text[end + 1 : end + 2].isdigit(),
    ]
    out += [10 + k for k, x in enumerate(checks) if x]
    before = text[max(0, start - 18) : start]
    return out + [36 + k for k, kind in enumerate(KINDS) if _CUES[kind].search(before)]


class Field:
    """Weights: span features by kind, and one for each pair of neighbouring labels (0: outside, then KINDS)."""

    def __init__(self, spans: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.spans = np.zeros((FEATURES, len(KINDS))) if spans is None else spans
        self.pairs = np.zeros((len(KINDS) + 1, len(KINDS) + 1)) if pairs is None else pairs

    def best(self, n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
        """The best segmentation of n tokens: its entities as (first, end token, kind)."""
        ending: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(segments):
            ending.setdefault(j, []).append(k)
        value = np.full((n + 1, len(KINDS) + 1), -np.inf)
        value[0, 0] = 0
        back: dict[tuple[int, int], tuple[int, int, int]] = {}
        for j in range(1, n + 1):
            before = value[j - 1] + self.pairs[:, 0]
            y = int(before.argmax())
            value[j, 0], back[j, 0] = before[y], (j - 1, y, -1)
            for k in ending.get(j, ()):
                i = segments[k][0]
                for kind in range(len(KINDS)):
                    before = value[i] + self.pairs[:, kind + 1]
                    y = int(before.argmax())
                    if (v := before[y] + scores[k, kind]) > value[j, kind + 1]:
                        value[j, kind + 1], back[j, kind + 1] = v, (i, y, kind)
        out, at = [], (n, int(value[n].argmax()))
        while at[0]:
            i, y, kind = back[at]
            if kind >= 0:
                out.append((i, at[0], kind))
            at = (i, y)
        return out[::-1]

    def added(self, text: str, triggers, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The field's spans in a text that meet none of those taken."""
        out = []
        for lo, hi in regions(text, triggers):
            cuts, segments = candidates(text, lo, hi)
            if not segments:
                continue
            scores = np.stack([self.spans[features(text, cuts[i], cuts[j])].sum(0) for i, j in segments])
            if scores.max() <= 0:
                continue
            for i, j, kind in self.best(len(cuts) - 1, segments, scores):
                start, end = cuts[i], cuts[j]
                if not any(a < end and start < b for _, a, b in taken):
                    out.append((KINDS[kind], start, end))
        return out

    def gradient(self, n: int, segments, matrix: np.ndarray, truth: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Of a region's log-likelihood, by forward and backward sums over all segmentations. truth: segment to kind."""
        scores = matrix @ self.spans
        kinds = len(KINDS)
        steps = [(j - 1, j, 0, -1) for j in range(1, n + 1)] + [(i, j, kind + 1, k) for k, (i, j) in enumerate(segments) for kind in range(kinds)]
        steps.sort(key=lambda x: x[1])
        forward = np.full((n + 1, kinds + 1), -np.inf)
        forward[0, 0] = 0
        for i, j, y, k in steps:
            s = 0.0 if k < 0 else scores[k, y - 1]
            forward[j, y] = np.logaddexp(forward[j, y], np.logaddexp.reduce(forward[i] + self.pairs[:, y]) + s)
        backward = np.full((n + 1, kinds + 1), -np.inf)
        backward[n] = 0
        total = np.logaddexp.reduce(forward[n])
        spans, pairs = np.zeros_like(self.spans), np.zeros_like(self.pairs)
        for i, j, y, k in sorted(steps, key=lambda x: -x[0]):
            tail = backward[j, y] + (0.0 if k < 0 else scores[k, y - 1])
            share = np.exp(forward[i] + self.pairs[:, y] + tail - total)
            pairs[:, y] -= share
            if k >= 0:
                spans[:, y - 1] -= matrix[k] * share.sum()
            backward[i] = np.logaddexp(backward[i], self.pairs[:, y] + tail)
        at, y = 0, 0
        starts = {segments[k][0]: (segments[k][1], kind + 1, k) for k, kind in truth.items()}
        while at < n:
            to, label, k = starts.get(at, (at + 1, 0, -1))
            pairs[y, label] += 1
            if k >= 0:
                spans[:, label - 1] += matrix[k]
            at, y = to, label
        return spans, pairs


def examples(seed: int, count: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled sentences: entities in many forms, and numbers that are none, among filler words."""
    rng = random.Random(seed)
    d = lambda n, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))
    word = lambda: "".join(rng.choice(("an", "be", "or", "ti", "the", "la", "es", "on", "ma", "in", "er", "st")) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        body = rng.choice("3456") + d(rng.choice((12, 13, 14, 14, 14)))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(("", "", " ", "-", "."))
        return sep.join(body[k : k + 4] for k in range(0, len(body), 4)) if sep else body

    def phone() -> str:
        a, b, c = d(3, "23456789"), d(3, "23456789"), d(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"+{d(2, '3469')} {d(2, '123')} {d(4)} {d(4)}", f"00{d(2, '3469')} {d(3, '123')} {d(6)}"))

    def email() -> str:
        name, host, top = rng.choice((word(), f"{word()}.{word()}", f"{word()}{d(2)}")), word(), rng.choice(("com", "org", "net", "de"))
        at, dot = rng.choice((("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("@", "."), (" [at] ", ".")))
        return f"{name}{at}{host}{dot}{top}"

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def wrong_card() -> str:
        x = d(16, "456")
        return x if not luhn(x) else x[:-1] + str((int(x[-1]) + 1) % 10)

    nothing = [
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", lambda: f"${d(2, '123')},{d(3)}.{d(2)}",
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", wrong_card, lambda: ".".join((d(3, "3456789"), d(3, "3456789"), d(2), d(3))), lambda: d(rng.randint(4, 12), "123456789"), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32)),
        lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(4)} {d(4)}", lambda: " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(3, 6))), lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"{word()} at {word()} the dot", lambda: f"#{d(6)}", lambda: f"{d(5)}-{d(4)}", lambda: f"{d(3)},{d(3)},{d(3)}", lambda: f"{d(8)}-{d(4)}-{d(4)}", lambda: f"1.{d(2)}.{d(2)}.{d(3)}.{d(2)}",
    ]
    cues = {"email": ("mail", "contact"), "ip": ("ip", "server"), "card": ("card", "visa"), "phone": ("phone", "call", "tel.")}
    made = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 6))), []
        for _ in range(rng.randint(1, 2)):
            text += " " if text else ""
            if rng.random() < 0.5:
                kind = rng.choice(KINDS)
                text += f"{rng.choice(cues[kind])} " if rng.random() < 0.3 else ""
                entity = made[kind]()
                spans.append((kind, len(text), len(text) + len(entity)))
                text += entity
            else:
                text += rng.choice(nothing)()
            text += rng.choice(("", "", ".", ",", "###", "!!")) + " " + " ".join(word() for _ in range(rng.randint(1, 8)))
        out.append((text, spans))
    return out


@lru_cache(maxsize=4)
def trained(seed: int = 11, count: int = 500, rounds: int = 40) -> Field:
    """Fits the field to `count` made sentences by AdaGrad on the likelihood, with a small penalty on large weights."""
    field, cases = Field(), []
    for text, spans in examples(seed, count):
        for lo, hi in regions(text, _TRIGGER.finditer(text)):
            cuts, segments = candidates(text, lo, hi)
            place = {(cuts[i], cuts[j]): k for k, (i, j) in enumerate(segments)}
            matrix = np.zeros((len(segments), FEATURES))
            for k, (i, j) in enumerate(segments):
                matrix[k, features(text, cuts[i], cuts[j])] = 1
            truth = {place[a, b]: KINDS.index(kind) for kind, a, b in spans if (a, b) in place}
            if segments:
                cases.append((len(cuts) - 1, segments, matrix, truth))
    rng, seen = random.Random(seed), [np.full_like(field.spans, 1e-3), np.full_like(field.pairs, 1e-3)]
    for k in range(rounds * 10):
        some = rng.sample(cases, min(20, len(cases)))
        spans, pairs = (sum(x) for x in zip(*(field.gradient(*case) for case in some)))
        for weights, g, total in ((field.spans, spans / len(some), seen[0]), (field.pairs, pairs / len(some), seen[1])):
            g = g - 2e-4 * weights
            total += g**2
            weights += 0.5 * g / np.sqrt(total)
    return field


def _find(batches, field: Field):
    for batch in batches:
        texts, triggered = batch.column(1), np.zeros(batch.num_rows, bool)
        for lo, hi, raw, at in text_slices(texts):
            mark = ((raw >= 48) & (raw <= 57)) | (raw == 64)
            total = np.concatenate([[0], np.cumsum(mark)])
            triggered[lo:hi] = total[at[1:]] > total[at[:-1]]
        written_out = np.asarray(pa.compute.fill_null(pa.compute.match_substring_regex(texts, _MAY_TRIGGER), False))
        base, every = [], []
        for k in range(batch.num_rows):
            if not (triggered[k] or written_out[k]):
                base.append([])
                every.append([])
                continue
            text = texts[k].as_py()
            spans = pattern_spans(text)
            base.append(spans)
            more = field.added(text, _TRIGGER.finditer(text), spans)
            every.append(sorted(spans + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else spans)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        lists = lambda rows: pa.array([[{"kind": a, "start": b, "end": c} for a, b, c in r] for r in rows], pa.list_(kind))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(base), lists(every)], names=["id", "base", "spans"])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row for each row of docs: id, base and spans, arrays of (kind, start, end): the patterns' spans, and all."""
    field = field or trained()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return rows.mapInArrow(lambda it: _find(it, field), f"id {rows.schema['id'].dataType.simpleString()}, base {spans}, spans {spans}")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


#: The field is not expressible in SQL; the patterns are tested against plain regular expressions.
SQL: dict[str, str] = {}
