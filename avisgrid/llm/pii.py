"""Personal data: fixed patterns, and spans added by a semi-Markov conditional random field.

The patterns find emails, IP addresses, cards and phone numbers; a match that fails its test is
dropped as a whole, which loses a phone number that other digits follow. The field scores
whole candidate spans (shape, digit count, checksum, borders) in the words around digits and at
signs; a semi-Markov Viterbi pass over segments of at most ``MAX_TOKENS`` tokens chooses
borders and kinds together. Its spans are added where no pattern's span lies.

The field is trained by likelihood on the words of about ``TRAIN_DOCS`` documents chosen by a
hash of the id, with the patterns' spans as truth. Every document is searched whole.
Null or empty texts have no spans; without training words nothing is added. Repeated rows stay, a null
id is carried, an empty table gives no rows, other columns are ignored. Counts are those of the patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avisgrid.llm import textblocks as tb
from avisgrid.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
TRAIN_DOCS = 4000
TRAIN_ZONES = 600
EPOCHS = 4
_SHARES = 1 << 20

Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these starts where a run of digits does, so runs are tried once each.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[\s\S]")
_DIGITS = re.compile(r"[0-9]")


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by start and kind."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
            done = domain.end()
        else:
            done = at + 1  # no match can cross an at sign
        at = text.find("@", max(at + 1, done))
    for kind, pattern, test in ((1, _IP, _ip_ok), (2, _CARD, _card_ok), (3, _PHONE, _phone_ok)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if test(m[0])]
    return sorted(found)


def zones(text: str) -> list[tuple[int, int]]:
    """Runs of neighbouring words that hold a digit or an at sign."""
    out: list[tuple[int, int]] = []
    for m in re.finditer(r"\S+", text):
        if "@" in m[0] or _DIGITS.search(m[0]):
            if out and not text[out[-1][1] : m.start()].strip(" "):
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
    return out


FEATURES = 18


def features(text: str, a: int, b: int, n_tokens: int) -> list[int]:
    """Indices of the features that hold for the whole span."""
    s = text[a:b]
    before, after = text[a - 1 : a], text[b : b + 1]
    d = _digits(s)
    on = [0]
    if "@" in s:
        on.append(1 if _EMAIL.fullmatch(s) else 2)
    elif _IP.fullmatch(s):
        on.append(3 if _ip_ok(s) else 4)
    elif _CARD.fullmatch(s):
        on.append(7 if not 12 <= len(d) <= 19 else 5 if luhn(d) else 6)
    elif _PHONE.fullmatch(s):
        on.append(8 if 9 <= len(d) <= 15 else 9)
    else:
        on.append(10)
    if before and (before.isalnum() or before in "_%+-@."):
        on.append(11)
    if after and (after.isalnum() or after in "_%@-"):
        on.append(12)
    if after in (".", ",", ")") and text[b + 1 : b + 2].isalnum():
        on.append(13)
    on.append(14 if n_tokens <= 3 else 15 if n_tokens <= 9 else 16)
    if "(" in s and ")" in s or s.count("-") + s.count(" ") == 3:
        on.append(17)
    return on


class Segments:
    """Tokens of a zone and the candidate spans that end at each."""

    def __init__(self, text: str, a: int, b: int) -> None:
        self.text = text
        self.cuts = [a + m.start() for m in _TOKEN.finditer(text[a:b])] + [b]
        self.n = len(self.cuts) - 1
        self.first = [text[c] for c in self.cuts[:-1]]

    def ending(self, j: int) -> list[tuple[int, list[int]]]:
        """First token and features of the candidates before cut ``j``."""
        last = self.first[j - 1]
        if not (last.isascii() and last.isalnum() or last == "-"):
            return []
        out, mark = [], False
        for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
            c = self.first[i]
            mark = mark or c == "@" or "0" <= c <= "9"
            if mark and (c in "+._%-" or c.isascii() and c.isalnum()):
                out.append((i, features(self.text, self.cuts[i], self.cuts[j], j - i)))
        return out


def _lse(x: np.ndarray, axis: int = 0) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Field:
    """Weights of span features by kind, and of neighbouring kinds (0: outside)."""

    def __init__(self) -> None:
        self.w = np.zeros((FEATURES, len(KINDS)))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def _score(self, on: list[int]) -> np.ndarray:
        return self.w[on].sum(0)

    def update(self, segments: Segments, gold: list[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log-likelihood; ``gold`` has first token, last cut, kind."""
        n, k = segments.n, len(KINDS)
        spans = [segments.ending(j) for j in range(n + 1)] if n else []
        spans[0] = []
        scores = [[self._score(on) for _, on in s] for s in spans]
        a = np.full((n + 1, k + 1), -np.inf)
        a[0, 0] = 0
        into = np.full((n + 1, k + 1), -np.inf)  # over the kind before, by the kind that starts
        into[0] = _lse(a[0][:, None] + self.t)
        for j in range(1, n + 1):
            a[j, 0] = into[j - 1, 0]
            if spans[j]:
                a[j, 1:] = _lse(np.array([into[i, 1:] + s for (i, _), s in zip(spans[j], scores[j])]))
            into[j] = _lse(a[j][:, None] + self.t)
        z = _lse(a[n])
        b = np.full((n + 1, k + 1), -np.inf)
        b[n] = 0
        starts = np.full((n, k + 1), -np.inf)  # of what follows a cut, by its kind
        for i in range(n, -1, -1):
            if i < n:
                starts[i, 0] = b[i + 1, 0]
                b[i] = _lse(self.t + starts[i][None, :], 1)
            for (p, _), s in zip(spans[i], scores[i]):
                starts[p, 1:] = np.logaddexp(starts[p, 1:], s + b[i, 1:])
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for j in range(1, n + 1):
            for (i, on), s in zip(spans[j], scores[j]):
                gw[on] -= np.exp(into[i, 1:] + s + b[j, 1:] - z)
        for i in range(n):
            gt -= np.exp(a[i][:, None] + self.t + starts[i][None, :] - z)
        state, at = 0, 0
        for i, j, kind in [*gold, (n, n, -1)]:
            for _ in range(at, i):
                gt[state, 0] += 1
                state = 0
            if kind >= 0:
                gt[state, kind + 1] += 1
                state, at = kind + 1, j
                gw[dict(spans[j])[i], kind] += 1
        self.w += rate * (gw - 1e-3 * self.w)
        self.t += rate * (gt - 1e-3 * self.t)

    def decode(self, text: str, a: int, b: int) -> list[Span]:
        """The best segmentation's spans; memory follows the tokens, not the candidates."""
        segments = Segments(text, a, b)
        n, k = segments.n, len(KINDS)
        best = np.full((n + 1, k + 1), -np.inf)
        best[0, 0] = 0
        into = np.zeros((n + 1, k + 1))
        into[0] = self.t[0]
        back: list[list[tuple[int, int]]] = [[(0, 0)] * (k + 1) for _ in range(n + 1)]
        came = np.zeros((n + 1, k + 1), np.int64)
        for j in range(1, n + 1):
            best[j, 0] = into[j - 1, 0]
            back[j][0] = (j - 1, int(came[j - 1, 0]))
            for i, on in segments.ending(j):
                total = into[i, 1:] + self._score(on)
                for kind in np.flatnonzero(total > best[j, 1:]) + 1:
                    best[j, kind] = total[kind - 1]
                    back[j][kind] = (i, int(came[i, kind]))
            step = best[j][:, None] + self.t
            came[j], into[j] = step.argmax(0), step.max(0)
        out, j, kind = [], n, int(best[n].argmax())
        while j:
            i, before = back[j][kind]
            if kind:
                out.append((segments.cuts[i], kind - 1, segments.cuts[j]))
            j, kind = i, before
        return out[::-1]


def train(docs: DataFrame) -> Field | None:
    """Fit the field on a bounded sample of the documents."""
    share = min(_SHARES, _SHARES * TRAIN_DOCS // max(1, docs.count()) + 1)
    place = F.xxhash64(F.col("doc_id").cast("long"), F.substring(F.md5(F.col("text").cast("binary")), 1, 8))
    sample = docs.select(F.col("text").cast("string").alias("text"), place.alias("h"))
    sample = sample.filter(F.col("text").rlike("[0-9@]") & (F.pmod("h", F.lit(_SHARES)) < share))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(zones(text)):
                    if b - a <= 400:  # of training words only; every zone is searched
                        out.append((h, k, text[a:b], text[a - 1 : a], text[b : b + 2]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*out)], ["h", "k", "zone", "before", "after"]
                )

    rows = sample.mapInArrow(extract, "h long, k long, zone string, before string, after string")
    rows = rows.orderBy("h", "k", "zone", "before", "after").limit(TRAIN_ZONES).collect()
    if not rows:
        return None
    field = Field()
    for epoch in range(EPOCHS):
        for r in rows:
            text = r["before"] + r["zone"] + r["after"]
            a = len(r["before"])
            b = a + len(r["zone"])
            segments = Segments(text, a, b)
            cut = {c: i for i, c in enumerate(segments.cuts)}
            gold: list[tuple[int, int, int]] = []
            for start, kind, end in base_spans(text):
                inside = start in cut and end in cut and cut[end] - cut[start] <= MAX_TOKENS
                if inside and (not gold or cut[start] >= gold[-1][1]):
                    gold.append((cut[start], cut[end], kind))
            field.update(segments, gold, 0.3 / (1 + epoch))
    return field


def spans_of(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and all spans."""
    base = base_spans(text)
    if field is None:
        return base, base
    found = list(base)
    for a, b in zones(text):
        for start, kind, end in field.decode(text, a, b):
            if all(end <= s or start >= e for s, _, e in base):
                found.append((start, kind, end))
    return base, sorted(found)


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _candidates(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, str]]:
    """Rows with a digit or an at sign, and their texts."""
    for lo, _, raw, offsets in tb.blocks(batch, column):
        octets = np.frombuffer(raw, np.uint8)
        hits = np.flatnonzero((octets == 64) | ((octets >= 48) & (octets <= 57)))
        for k in np.unique(np.searchsorted(offsets, hits, "right") - 1).tolist():
            yield lo + k, raw[offsets[k] : offsets[k + 1]].decode()


def find(docs: DataFrame) -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans, of every document."""
    field = train(docs)
    nothing = hashlib.sha256(b"").hexdigest()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((len(KINDS), batch.num_rows), np.int64)
            digests, written = [nothing] * batch.num_rows, [""] * batch.num_rows
            for row, text in _candidates(batch):
                base, found = spans_of(text, field)
                for _, kind, _ in base:
                    counts[kind, row] += 1
                digests[row] = hashlib.sha256(_written(base).encode()).hexdigest()
                written[row] = _written(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(written, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(
        search, f"doc_id long, {counts}, base_sha256 string, spans string"
    )


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans go together."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, kind, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, kind, b])
    for a, kind, b in merged:
        out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """All documents with their spans masked; ``n_chars``, if there is one, follows the text."""
    field = train(docs)
    names = docs.columns
    at = names.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = {}
            for row, text in _candidates(batch):
                spans = spans_of(text, field)[1]
                if spans:
                    changed[row] = masked(text, spans)
            if changed:
                rows = np.zeros(batch.num_rows, bool)
                rows[list(changed)] = True
                column = batch.column(at)
                column = pa.compute.replace_with_mask(
                    column, pa.array(rows), pa.array([changed[r] for r in sorted(changed)], column.type)
                )
                batch = batch.set_column(at, "text", column)
            yield batch

    out = map_rows(docs, mask)
    if "n_chars" in names:
        n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), n).otherwise(F.col("n_chars")))
    return out
