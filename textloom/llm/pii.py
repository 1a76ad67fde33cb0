"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Candidates are spans of four base kinds (email, ip, card, phone), whose rules
are exact, and of four looser kinds (secret, local_phone, national_id,
masked_email). Five labelers vote for (+1), against (-1) or not at all (0) on
each: the rule itself, a gazetteer (top-level domains, issuer and country
prefixes, key prefixes), the words before it, its shape, and what stands right
beside it. Vote patterns are counted over all texts; they are few whatever the
corpus, so only these counts reach the driver. There expectation-maximisation
(a two-class model of conditionally independent labelers, a prior for each
kind) estimates how reliable each labeler is, and its posteriors train a
logistic span classifier on kind, votes, length and share of digits. Base
spans always stay; looser ones stay where the classifier says so and they
don't overlap a base span.

Scans are linear in the text: runs that a pattern could enter at many places
are entered once.

Defined cases: a null or empty text has no spans; repeated rows each have
theirs; offsets are code points, ends exclusive; an empty table gives an empty
result; extra columns stay unread.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ship, slices, table, two

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "local_phone", "national_id", "masked_email")
LABELERS = 5
PART_BYTES = 4 << 20

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?[\[(](?:at|AT)[\])][\x20]?[A-Za-z0-9-]++(?:[\x20]?[\[(](?:dot|DOT)[\])][\x20]?[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")

_DOMAINS = frozenset("com org net edu gov mil int info biz io co dev app ai me us uk de fr es it nl be ch at pt pl ru cn jp kr in br mx ar ca au nz se no dk fi cz gr tr za ie eu".split())
_KEYS = ("sk-", "sk_", "pk_", "ghp_", "gho_", "xox", "AKIA", "ASIA", "AIza", "eyJ", "glpat-")
_COUNTRY = re.compile(r"\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2\d\d|3[578]\d|42\d|59\d|67\d|85\d|88\d|97\d|99\d)")
_FOR = re.compile(r"(?i)(mail|contact|write|phone|tel|call|fax|mobile|whatsapp|card|visa|master|amex|credit|ip|host|server|address|token|secret|key|passw|pwd|auth|bearer|credential|ssn|social|courriel|correo|telefon|tel[eé]fono|t[eé]l[eé]phone|karte|tarjeta|carte|schl[uü]ssel|clave|cl[eé])[\w-]{0,12}[^\w]{0,5}$")
_AGAINST = re.compile(r"(?i)(version|isbn|issn|doi|section|chapter|page|figure|table|licen[cs]e|build|revision|commit|checksum|sha\d*|md5|serial|order|invoice|http\S*|www\S*|path|/)[^\w]{0,5}$")


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base kinds, by start, then kind."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((3, *m.span()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser kinds that lie in no base span."""
    out = []
    if _DIGIT.search(text):
        for m in _SECRET.finditer(text):
            s = m.group()
            if sum(map(str.isdigit, s)) >= 3 and sum(map(str.isalpha, s)) >= 3:
                out.append((4, *m.span()))
        out += [(5, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        out += [(6, *m.span()) for m in _NATIONAL.finditer(text)]
    if "[" in text or "(" in text:
        out += [(7, *m.span()) for m in _MASKED.finditer(text)]
    return [x for x in out if outside(x, base)] if base else out


def outside(span: tuple[int, int, int], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The parts of a span that no base span (these by start) covers."""
    kind, at, stop = span
    out = []
    for _, a, b in base:
        if at < b and a < stop:
            if at < a:
                out.append((kind, at, a))
            at = b
    return [*out, (kind, at, stop)] if at < stop else out


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """+1, 0 or -1 of each labeler."""
    s = text[start:end]
    rule = 1 if kind < len(BASE) else 0
    gazetteer = 0
    if kind in (0, 7):
        gazetteer = 1 if s.rstrip(")] ").rsplit(".", 1)[-1].lower() in _DOMAINS or any(s.lower().endswith(d) for d in (" com", ")com", "]com", " org", " net")) else -1
    elif kind == 1:
        first = int(s.split(".", 1)[0].lstrip("0") or 0)
        gazetteer = -1 if first == 0 or first >= 240 else 1
    elif kind == 2:
        gazetteer = 1 if s[0] in "3456" else -1
    elif kind == 3:
        gazetteer = 1 if _COUNTRY.match(s) else -1
    elif kind == 4:
        gazetteer = 1 if s.startswith(_KEYS) else 0
    elif kind == 6:
        gazetteer = -1 if s[:3] in ("000", "666") or s[0] == "9" else 1
    before = text[max(0, start - 40) : start]
    context = 1 if _FOR.search(before) else -1 if _AGAINST.search(before) else 0
    distinct = len(set(s))
    if kind == 4:
        shape = 1 if distinct >= 10 and sum(map(str.isdigit, s)) >= 5 else -1
    else:
        shape = -1 if len(set(c for c in s if c.isdigit())) < 2 and kind != 0 and kind != 7 else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    quoted = left in "\"'`" and right in "\"'`" and left != ""
    beside = 1 if quoted else -1 if left.isalnum() or right.isalnum() or right in ("_", "/") and right else 0
    return rule, gazetteer, context, shape, beside


def pattern(text: str, span: tuple[int, int, int]) -> int:
    """What the classifier sees of a span, as one number: kind, votes, length bin, digit-share bin."""
    kind, start, end = span
    key = kind
    for v in votes(text, kind, start, end):
        key = key * 3 + v + 1
    length, digits = end - start, sum(c.isdigit() for c in text[start:end])
    return (key * 8 + min(7, length.bit_length())) * 5 + min(4, 5 * digits // length)


def _unpack(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    digits, keys = keys % 5, keys // 5
    length, keys = keys % 8, keys // 8
    v = np.zeros((len(keys), LABELERS), np.int64)
    for i in range(LABELERS - 1, -1, -1):
        v[:, i] = keys % 3 - 1
        keys = keys // 3
    return keys, v, length, digits


def reliabilities(kind: np.ndarray, v: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern being personal data, and P(vote is +1 | class, it votes) as (labeler, class), by EM.

    A labeler that doesn't vote says nothing; the prior is of the kind.
    """
    p = 1 / (1 + np.exp(-1.5 * v.sum(1)))
    right = np.zeros((LABELERS, 2))
    for _ in range(rounds):
        both = np.stack((counts * (1 - p), counts * p))
        prior = np.array([[(both[c] * (kind == k)).sum() + 1 for c in (0, 1)] for k in range(len(KINDS))])
        prior /= prior.sum(1, keepdims=True)
        for i in range(LABELERS):
            for c in (0, 1):
                yes, no = (both[c] * (v[:, i] == 1)).sum(), (both[c] * (v[:, i] == -1)).sum()
                # smoothed towards a labeler that is right more often than not
                right[i, c] = (yes + (3 if c else 1)) / (yes + no + 4)
        logit = np.log(prior[kind, 1]) - np.log(prior[kind, 0])
        for i in range(LABELERS):
            logit = logit + np.where(v[:, i] == 1, np.log(right[i, 1] / right[i, 0]), np.where(v[:, i] == -1, np.log((1 - right[i, 1]) / (1 - right[i, 0])), 0.0))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, right


def train(keys: np.ndarray, counts: np.ndarray, steps: int = 400) -> dict[int, float]:
    """The final classifier's probability for each pattern: logistic regression on the posteriors of EM."""
    if not len(keys):
        return {}
    kind, v, length, digits = _unpack(keys)
    target, _ = reliabilities(kind, v, counts.astype(float))
    columns = [kind == k for k in range(len(KINDS))] + [v[:, i] == x for i in range(LABELERS) for x in (-1, 1)] + [length == k for k in range(8)] + [digits == k for k in range(5)]
    x = np.stack(columns, 1).astype(float)
    weight = np.log1p(counts)
    weight = weight / weight.sum()
    w, g2 = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (weight * (p - target)) + 1e-4 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return dict(zip(keys.tolist(), (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


def as_string(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_SPANS = "array<struct<kind:int,start:int,stop:int,pattern:int>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, stop, pattern) of all candidates in each row's text; base kinds are below 4."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("pattern", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            out = []
            for text in part.column(1).to_pylist():
                base = base_spans(text)
                out.append([{"kind": s[0], "start": s[1], "stop": s[2], "pattern": pattern(text, s)} for s in base + loose_spans(text, base)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return two(docs, id_col, text_col).mapInArrow(run, f"doc_id long, spans {_SPANS}")


def fit(found: DataFrame) -> dict[int, float]:
    """The classifier from the candidates of all texts; the patterns are few whatever the corpus."""
    rows = found.select(F.explode("spans.pattern").alias("p")).groupBy("p").count().orderBy("p").collect()
    return train(np.array([r["p"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64))


def chosen(spans: list[dict], model: dict[int, float]) -> list[tuple[int, int, int]]:
    """Base spans, and the parts outside them of the looser ones that the classifier takes, by start, then kind."""
    base = [(s["kind"], s["start"], s["stop"]) for s in spans if s["kind"] < len(BASE)]
    loose = [p for s in spans if s["kind"] >= len(BASE) and model.get(s["pattern"], 0) >= 0.5 for p in outside((s["kind"], s["start"], s["stop"]), base)]
    return sorted(base + loose, key=lambda x: (x[1], x[0], x[2]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs."""
    found = table(candidates(docs, id_col, text_col), "spans")
    held = found.sparkSession.sparkContext.broadcast(fit(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            base = [[(s["kind"], s["start"], s["stop"]) for s in r if s["kind"] < len(BASE)] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    *(pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in range(len(BASE))),
                    pa.array([hashlib.sha256(as_string(r).encode()).hexdigest() for r in base], pa.string()),
                    pa.array([as_string(chosen(r, held.value)) for r in rows], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, model: dict[int, float]) -> str:
    """The text with each chosen span, or run of overlapping ones, as the kind of its first in brackets."""
    base = base_spans(text)
    spans = base + [p for s in loose_spans(text, base) if model.get(pattern(text, s), 0) >= 0.5 for p in outside(s, base)]
    if not spans:
        return text
    out, at, end = [], 0, 0
    for kind, start, stop in sorted(spans, key=lambda x: (x[1], x[0])):
        if start >= end:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        end = at = max(end, stop)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, its text redacted. The classifier is fitted on all its texts."""
    from pyspark.sql import types as T

    found = table(candidates(docs.select(F.lit(None).cast("long").alias("doc_id"), docs[text_col].alias("text"))).where(F.size("spans") > 0), "spans")
    held = docs.sparkSession.sparkContext.broadcast(fit(found))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES, text_col):
            columns = list(part.columns)
            columns[at] = pa.array([None if x is None else redact(x, held.value) for x in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
