"""Personal data by weak supervision.

Strict patterns find base spans, looser ones find further candidates. Five
labelers vote on every candidate (yes, no or abstain): the strict pattern, the
shape (check digit, number of digits, octets), gazetteers (calling codes,
issuer prefixes, top-level domains, reserved networks), words before the span,
and the characters around it. Votes form at most 4 x 3^5 patterns; their counts
are added up by Spark, expectation-maximisation estimates how reliable each
labeler is for each kind, and its posteriors train the final span classifier, a
logistic regression over the votes and the form of the span. Base spans always
stay; the classifier adds candidates that it is sure of.

Positions are code points, the end is exclusive. Null and empty texts have no
span. Rows that repeat a document are judged alike. Without any candidate in
the corpus nothing is added. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import pin, prepare, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.95
ROUNDS = 50
CONTEXT_CHARS = 40
YES, NO, NONE = 1, 0, 2
LABELERS = ("strict", "shape", "gazetteer", "context", "edges")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser forms: an address with its signs spelled out, a number without the
# plus sign, a card number grouped by points or slashes, a version-6 address.
_LOOSE = (
    ("email", re.compile(r"\b[\w.%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{1,63}){1,5}", re.I)),
    ("phone", re.compile(r"(?<![\w+.])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w])")),
    ("card", re.compile(r"(?<![\w.])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{2,4}(?![\w.])")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")),
)
_WORDS = {
    "email": ("mail", "correo", "courriel", "contact", "kontakt", "write to"),
    "ip": ("ip", "address", "host", "server", "dirección", "adresse", "from"),
    "card": ("card", "visa", "mastercard", "amex", "tarjeta", "carte", "karte", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "llame", "appel", "anruf", "whatsapp"),
}
_AGAINST = ("version", "order", "isbn", "sku", "serial", "invoice", "token", "hash", "build", "license")
_TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name io co me tv app dev ai eu us uk de fr es it nl be ch at se no dk fi "
    "pl pt br mx ar cl ca au nz jp cn kr in ru ua gr ie cz hu ro tr za example test".split()
)
_ISSUERS = re.compile(r"(?:4|5[1-5]|2[2-7]|3[0-9]|6)")
_RESERVED = re.compile(r"(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around every sign: all local characters before it, then the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strict patterns, by start, then kind."""
    found = [("email", a, z) for a, z in _emails(text)]
    for m in _IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates, none of which touches a base span or an earlier candidate."""
    found: list[tuple[str, int, int]] = []
    taken = None
    for kind, pattern in _LOOSE:
        for m in pattern.finditer(text):
            if taken is None:
                taken = bytearray(len(text))
                for _, a, z in base:
                    taken[a:z] = b"\1" * (z - a)
            if not any(taken[m.start() : m.end()]):
                found.append((kind, m.start(), m.end()))
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return found


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> list[int]:
    """One vote of every labeler."""
    span = text[start:end]
    digits = _digits(span)
    before = text[max(0, start - CONTEXT_CHARS) : start].lower()
    if kind == "email":
        shape = YES if re.search(r"[\w%+-]", span[:1]) else NO
        tail = re.split(r"[^A-Za-z0-9]+", span.rstrip(")]} "))[-1].lower()
        listed = YES if tail in _TOP_LEVEL else NO
    elif kind == "ip":
        parts = span.split(".")
        shape = YES if ":" in span or all(p == str(int(p)) for p in parts if len(p) < 9) else NO
        listed = NO if _RESERVED.match(span) else YES
    elif kind == "card":
        shape = YES if 14 <= len(digits) <= 19 and luhn(digits) else NO
        listed = YES if _ISSUERS.match(digits) else NO
    else:
        shape = YES if 10 <= len(digits) <= 15 else NO
        listed = YES if span[:1] == "+" or span[:2] == "00" or span[:1] == "(" else NONE
    if any(w in before for w in _AGAINST):
        context = NO
    else:
        context = YES if any(re.search(rf"\b{w}", before) for w in _WORDS[kind]) else NONE
    around = text[start - 1 : start] + text[end : end + 1]
    edges = NO if any(c.isalnum() for c in around) else YES
    return [YES if strict else NONE, shape, listed, context, edges]


def _code(kind: str, cast: list[int]) -> int:
    """A pattern as a number: the kind, then the votes in base 3."""
    code = KINDS.index(kind)
    for v in cast:
        code = code * 3 + v
    return code


def _decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    columns = []
    for _ in LABELERS:
        columns.append(codes % 3)
        codes = codes // 3
    return codes, np.stack(columns[::-1], axis=1)


_SPAN = "array<struct<kind:int,start:int,end:int,code:int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, loose)``: the spans of every document with their votes, written once."""
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "code")]))

    def pack(text: str, spans: list[tuple[str, int, int]], strict: bool) -> list[dict]:
        return [
            {"kind": KINDS.index(k), "start": a, "end": z, "code": _code(k, votes(text, k, a, z, strict))}
            for k, a, z in spans
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, loose = [], []
            for value in batch.column(1):
                text = value.as_py()
                own = base_spans(text)
                base.append(pack(text, own, True))
                loose.append(pack(text, loose_spans(text, own), False))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, kind), pa.array(loose, kind)], ["doc_id", "base", "loose"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return pin(rows.mapInArrow(run, f"doc_id long, base {_SPAN}, loose {_SPAN}"), "pii-candidates")


def reliabilities(kinds: np.ndarray, cast: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior of every vote pattern being personal data, by expectation-maximisation.

    For each kind: the share of true spans, and for each labeler how often it
    votes yes, no or nothing on true and on false spans. It starts from the
    majority of votes, with one pseudo-count for each outcome.
    """
    posterior = np.zeros(len(counts))
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        v, n = cast[own], counts[own].astype(float)
        yes, no = (v == YES).sum(axis=1), (v == NO).sum(axis=1)
        p = (yes + 1.0) / (yes + no + 2.0)
        for _ in range(ROUNDS):
            prior = ((p * n).sum() + 1.0) / (n.sum() + 2.0)
            log_odds = np.full(len(own), np.log(prior) - np.log1p(-prior))
            for j in range(v.shape[1]):
                for outcome in (YES, NO, NONE):
                    hit = v[:, j] == outcome
                    true = ((p * n)[hit].sum() + 1.0) / ((p * n).sum() + 3.0)
                    false = (((1 - p) * n)[hit].sum() + 1.0) / (((1 - p) * n).sum() + 3.0)
                    log_odds[hit] += np.log(true) - np.log(false)
            p = 1.0 / (1.0 + np.exp(-np.clip(log_odds, -30, 30)))
        posterior[own] = p
    return posterior


def _design(kinds: np.ndarray, cast: np.ndarray) -> np.ndarray:
    """Features of the span classifier: kind, votes, and votes within the kind."""
    hot = np.eye(len(KINDS))[kinds]
    signs = np.where(cast == YES, 1.0, np.where(cast == NO, -1.0, 0.0))
    mixed = (hot[:, :, None] * signs[:, None, :]).reshape(len(kinds), -1)
    return np.concatenate([hot, signs, mixed], axis=1)


def train(patterns: pd.DataFrame, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of the span classifier, from ``(code, n)`` of all candidates."""
    kinds, cast = _decode(patterns["code"].to_numpy().astype(np.int64))
    counts = patterns["n"].to_numpy().astype(float)
    target = reliabilities(kinds, cast, counts)
    x = _design(kinds, cast)
    weights = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps of a ridge logistic regression
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counts * (target - p)) - penalty * weights
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        weights = weights + np.linalg.solve(bend, slope)
    return weights


def probability(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    kinds, cast = _decode(codes.astype(np.int64))
    return 1.0 / (1.0 + np.exp(-np.clip(_design(kinds, cast) @ weights, -30, 30)))


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``(doc_id, base, spans)`` of every document, spans as ``(kind, start, end)`` in order."""
    table = candidates(docs)
    codes = table.select(F.explode(F.concat("base.code", "loose.code")).alias("code"))
    counted = codes.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()  # 972 rows at most
    patterns = pd.DataFrame([tuple(r) for r in counted], columns=["code", "n"])
    sure: list[int] = []
    if len(patterns):
        weights = train(patterns)
        seen = patterns["code"].to_numpy()
        sure = [int(c) for c in seen[probability(seen, weights) >= accept]]
    names = F.array(*[F.lit(k) for k in KINDS])

    def plain(span):
        return F.struct(span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end"))

    added = F.filter("loose", lambda s: s["code"].isin(sure)) if sure else F.filter("loose", lambda s: F.lit(False))
    ordered = F.array_sort(F.transform(F.concat("base", added), plain))
    named = lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return table.select(
        "doc_id",
        F.transform(F.array_sort(F.transform("base", plain)), named).alias("base"),
        F.transform(ordered, named).alias("spans"),
    )


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans are taken once."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """SHA-256 of the spans as text."""
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()
