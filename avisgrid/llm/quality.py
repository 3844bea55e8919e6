"""Quality classifier by co-training of two views.

Text view: hashed character trigrams of the whole text. Page view: metadata of the row (source,
language, stated and real length) and of its layout (lines, capitals, digits, symbols,
blanks). Each view starts from the labelled rows; in every round each scores the unlabelled
pool and hands its most confident documents, as pseudo-labels, to the other. Both views are
then calibrated on labelled rows kept aside, and a logistic combination of the calibrated
views, fitted on the same rows, scores every document. Scores of ``THRESHOLD`` or more are
kept.

Training is bounded: ``LABELLED`` labelled rows with the lowest hash of their id, and about
``POOL`` unlabelled documents chosen by the same hash. Repeated labels of an id count as their
lowest. With fewer than two classes among the labels every document scores 1.0. A null text
counts as empty; null metadata is a category of its own. Repeated rows stay, an empty table
gives no rows, missing metadata columns count as null and other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avisgrid.llm import textblocks as tb
from avisgrid.llm.common import map_rows

LABELLED = 6000
POOL = 6000
ROUNDS = 5
PER_ROUND = 300  # documents a view may hand over in a round, both classes together
CONFIDENT = 0.95
THRESHOLD = 0.3  # below one half: short documents give little evidence, and clean ones stay
TRIGRAMS = 1024
SOURCES, LANGS = 32, 16
ROWS = 1024
_SHARES = 1 << 20
_KINDS = 7  # lower case, upper case, digit, blank, line break, other ASCII, beyond ASCII
PAGE = _KINDS + 6 + SOURCES + LANGS


def _kind_table() -> np.ndarray:
    table = np.full(128, 5, np.uint8)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[[9, 11, 12, 13, 32]], table[10] = 3, 4
    return table


def _slot(value, size: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(str(value).encode()) % (size - 1)


def _slots(values: pa.Array, size: int) -> np.ndarray:
    coded = values.dictionary_encode()
    slots = np.array([_slot(v, size) for v in coded.dictionary.to_pylist()] + [0], np.int64)
    return slots[pa.compute.fill_null(coded.indices, len(slots) - 1).to_numpy(zero_copy_only=False)]


def _repeats(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of words that occurred before in the text, and that repeat the word before."""
    n = len(offsets) - 1
    starts, stops, row = tb.words(~tb.blank(points), offsets)
    h = tb.span_hashes(points, starts, stops)
    total = np.maximum(np.bincount(row, minlength=n), 1)
    order = np.lexsort((h, row))
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    counts = [np.bincount(row[order][1:][again], minlength=n), np.bincount(row[1:][same], minlength=n)]
    return np.stack(counts, 1) / total[:, None]


def features(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Text and page features of the rows (columns text, lang, source, n_chars), in parts."""
    kinds = _kind_table()
    names = batch.schema.names
    langs, sources = (_slots(batch.column(names.index(c)), s) for c, s in (("lang", LANGS), ("source", SOURCES)))
    stated = pa.compute.fill_null(batch.column(names.index("n_chars")), 0).to_numpy(zero_copy_only=False)
    for part in range(0, batch.num_rows, ROWS):
        for lo, hi, raw, offsets in tb.blocks(batch.slice(part, ROWS), "text"):
            n = hi - lo
            lo, hi = part + lo, part + hi
            _, points, offsets = tb.code_points(raw, offsets)
            row = np.repeat(np.arange(n), np.diff(offsets))
            gram = (points[:-2] * 31 + points[1:-1]) * 31 + points[2:] if len(points) > 2 else points[:0]
            gram = ((gram * np.uint32(2654435761)) >> np.uint32(22)) % TRIGRAMS
            same = row[:-2] == row[2:]
            counts = np.bincount(row[:-2][same] * TRIGRAMS + gram[same], minlength=n * TRIGRAMS)
            counts = counts.reshape(n, TRIGRAMS)
            text = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)
            kind = np.where(points < 128, kinds[np.minimum(points, 127)], 6).astype(np.int64)
            mix = np.bincount(row * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS)
            length = np.diff(offsets)
            page = np.zeros((n, PAGE), np.float32)
            page[:, :_KINDS] = np.sqrt(mix / np.maximum(length, 1)[:, None])
            page[:, _KINDS] = np.log1p(length) / 10
            page[:, _KINDS + 1] = np.log1p(np.maximum(stated[lo:hi], 0)) / 10
            page[:, _KINDS + 2] = np.log1p(length / (mix[:, 4] + 1)) / 10
            page[:, _KINDS + 3] = np.log1p(length / (mix[:, 3] + 1)) / 10
            page[:, _KINDS + 4 : _KINDS + 6] = _repeats(points, offsets)
            page[np.arange(n), _KINDS + 6 + sources[lo:hi]] = 1
            page[np.arange(n), _KINDS + 6 + SOURCES + langs[lo:hi]] = 1
            yield lo, hi, text, page


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _single(x: np.ndarray) -> np.ndarray:
    """Features kept in half precision as those they were made from."""
    return x.astype(np.float32) if x.dtype == np.float16 else x


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 200) -> np.ndarray:
    """Weights and bias by accelerated gradient descent; classes weigh the same."""
    given, x = x, np.ones((len(x), x.shape[1] + 1), np.float32 if x.dtype == np.float16 else x.dtype)
    x[:, :-1] = given
    del given
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    share, y = share.astype(x.dtype), y.astype(x.dtype)
    squares = np.concatenate([(x[lo : lo + ROWS] ** 2).sum(1) for lo in range(0, len(x), ROWS)])
    rate = 1 / (0.25 * (share @ squares) + l2)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        slope = x.T @ (share * (_sigmoid(x @ ahead) - y)) + l2 * ahead
        new = (ahead - rate * slope).astype(x.dtype)
        ahead = new + x.dtype.type(k / (k + 3)) * (new - w)
        w = new
    return w


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = _single(x)
    return x @ w[:-1].astype(x.dtype) + w[-1]


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of few features by Newton steps, classes as frequent as they are."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + 1e-2 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


@dataclass
class Model:
    """Margins of both views, their calibrations and the combination."""

    views: list[np.ndarray]
    scales: list[np.ndarray]
    both: np.ndarray

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = [
            np.clip(s[0] * _margin(x, w) + s[1], -12, 12)
            for x, w, s in zip((text, page), self.views, self.scales)
        ]
        joint = self.both[0] * logits[0] + self.both[1] * logits[1] + self.both[2]
        return _sigmoid(logits[0]), _sigmoid(logits[1]), _sigmoid(joint)


def cotrain(views: list[np.ndarray], y: np.ndarray, hashes: np.ndarray) -> Model | None:
    """Train on rows of both views; ``y`` is 0, 1 or -1 for rows of the pool.

    Every third labelled row, in the order of its hash, calibrates.
    """
    labelled = np.flatnonzero(y >= 0)
    labelled = labelled[np.argsort(hashes[labelled], kind="stable")]
    aside = np.zeros(len(y), bool)
    aside[labelled[2::3]] = True
    train, pool = (y >= 0) & ~aside, y < 0
    if any(len(np.unique(y[part])) < 2 for part in (train, aside)):
        return None
    known = [np.where(train, y, -1) for _ in views]
    l2 = (1e-5, 1e-5)

    def fit(v: int) -> np.ndarray:
        rows = known[v] >= 0
        return _logistic(views[v][rows], known[v][rows].astype(float), l2[v])

    rare = (y[train] == 0).mean()
    for _ in range(ROUNDS):
        weights = [fit(v) for v in range(2)]
        for v in range(2):
            rows = np.flatnonzero(pool & (known[1 - v] < 0))
            p = _sigmoid(_margin(views[v][rows], weights[v]))
            for label, share in ((0, rare), (1, 1 - rare)):
                sure = p if label else 1 - p
                most = np.argsort(-sure, kind="stable")[: max(1, int(PER_ROUND * share))]
                known[1 - v][rows[most[sure[most] >= CONFIDENT]]] = label
    weights = [fit(v) for v in range(2)]
    margins = [_margin(x[aside], w) for x, w in zip(views, weights)]
    truth = y[aside].astype(float)
    scales = [_calibrated(m[:, None].astype(float), truth) for m in margins]
    logits = [np.clip(s[0] * m + s[1], -12, 12) for m, s in zip(margins, scales)]
    return Model(weights, scales, _calibrated(np.stack(logits, 1), truth))


_INPUT = ("text string", "lang string", "source string", "n_chars long")


def _inputs(docs: DataFrame) -> list:
    given = set(docs.columns)
    return [
        (F.col(n) if n in given else F.lit(None)).cast(t).alias(n) for n, t in map(str.split, _INPUT)
    ]


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample; None if the labels have fewer than two classes."""
    place = F.xxhash64(F.col("doc_id").cast("long"))
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.min("quality").cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(LABELLED)
    )
    n_docs = docs.count()
    share = min(_SHARES, _SHARES * POOL // max(1, n_docs) + 1)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("_id"), place.alias("_h"), *_inputs(docs))
        .join(F.broadcast(known), "_id", "left")  # at most LABELLED rows
        .filter(F.col("_y").isNotNull() | (F.pmod("_h", F.lit(_SHARES)) < share))
        .select("_h", F.coalesce("_y", F.lit(-1)).cast("int").alias("_y"), "text", "lang", "source", "n_chars")
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for lo, hi, text, page in features(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([squeeze(x.tobytes()) for x in text.astype(np.float16)], pa.binary()),
                        pa.array([x.tobytes() for x in page], pa.binary()),
                    ],
                    ["h", "y", "text", "page"],
                )

    sample = rows.mapInArrow(extract, "h long, y int, text binary, page binary").toArrow()
    h, y = (sample.column(i).to_numpy() for i in (0, 1))
    text, page = sample.column(2).to_pylist(), sample.column(3).to_pylist()
    plain = zstandard.ZstdDecompressor().decompress
    # Rows come in any order: sort them, so that every run fits the same model.
    order = np.lexsort((y, h))
    if not len(order):
        return None
    new = (h[order][1:] != h[order][:-1]) | (y[order][1:] != y[order][:-1])
    first = np.flatnonzero(np.append(True, new))
    for lo, hi in zip(first, np.append(first[1:], len(order))):
        if hi > lo + 1:
            order[lo:hi] = sorted(order[lo:hi], key=lambda i: (plain(text[i]), page[i]))
    views = [np.empty((len(order), TRIGRAMS), np.float16), np.empty((len(order), PAGE), np.float32)]
    for row, i in enumerate(order):
        views[0][row] = np.frombuffer(plain(text[i]), np.float16)
        views[1][row] = np.frombuffer(page[i], np.float32)
    del sample, text, page
    return cotrain(views, y[order], h[order])


def _scored(batch: pa.RecordBatch, model: Model | None) -> list[np.ndarray]:
    """Text, page and joint score of every row."""
    out = [np.ones(batch.num_rows) for _ in range(3)]
    if model is not None:
        for lo, hi, text, page in features(batch):
            for column, values in zip(out, model.scores(text, page)):
                column[lo:hi] = values
    return out


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Calibrated scores of every document, and whether it is kept."""
    model = train(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, page, joint = _scored(batch, model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (text, page, joint, joint >= threshold))],
                ["doc_id", "text_score", "page_score", "score", "keep"],
            )

    return docs.select(F.col("doc_id").cast("long"), *_inputs(docs)).mapInArrow(
        score, "doc_id long, text_score double, page_score double, score double, keep boolean"
    )


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, all columns kept."""
    model = train(docs, labels)
    given = set(docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
        for batch in batches:
            view = [
                batch.column(batch.schema.get_field_index(n)).cast(t) if n in given else pa.nulls(batch.num_rows, t)
                for n, t in kinds.items()
            ]
            view = pa.RecordBatch.from_arrays(view, list(kinds))
            yield batch.filter(pa.array(_scored(view, model)[2] >= threshold))

    return map_rows(docs, keep)
