"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. A trigram binds
(multiplies) the vectors of its letters, permuted (rotated) by place; a document bundles
(adds) its trigrams, blanks between words included; a language bundles the unit vectors of
its documents. The prediction is the prototype with the largest cosine, the first in
alphabetical order on ties.

Prototypes are learned from about ``TRAIN_PER_LANG`` documents of each language, chosen by
a hash of the id among those outside the held-out fifth with text and language; every
document is predicted from its whole text. A null text, or one without letters, is ``und``
with score 0, and so is every text when nothing could be learned. Null ids are never held
out. Repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avisgrid.llm import textblocks as tb
from avisgrid.llm.common import held_out

DIMENSIONS = 512
TRAIN_PER_LANG = 2000
HELD_OUT = 0
UNKNOWN = "und"
ROWS = 512  # documents bundled at once
DISTINCT = 8192  # trigrams of a block that are counted in a table
AT_ONCE = 1 << 14  # trigrams bound at once otherwise
SCALE = 1 << 24  # unit vectors are summed as whole numbers, in any order
_SHARES = 1 << 20


class Encoder:
    """Bundles of the trigrams of texts."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.folder = tb.Folder(str.isalpha)
        self.letters: dict[int, np.ndarray] = {}

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            bits = np.random.default_rng(point).integers(0, 2, self.dimensions, np.int8)
            self.letters[point] = 2 * bits - 1
        return self.letters[point]

    def bundles(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """One row for each text; all zeros without a letter."""
        _, points, offsets = tb.code_points(raw, offsets)
        n = len(offsets) - 1
        # One blank before every text and after the last; runs of other characters are one.
        letters = np.zeros(len(points) + n + 1, np.int32)
        row = np.repeat(np.arange(n), np.diff(offsets))
        letters[np.arange(len(points)) + row + 1] = self.folder.fold(points)
        opens = offsets + np.arange(n + 1)
        keep = np.ones(len(letters), bool)
        keep[1:] = (letters[1:] > 0) | (letters[:-1] > 0)
        keep[opens] = True
        doc = np.searchsorted(opens, np.flatnonzero(keep), "right") - 1
        used, letters = np.unique(letters[keep], return_inverse=True)
        same = doc[:-2] == doc[1:-1]
        side = len(used)
        letters = letters.astype(np.int64)
        gram = ((letters[:-2] * side + letters[1:-1]) * side + letters[2:])[same]
        doc = doc[:-2][same]
        lettered = np.zeros(n, bool)
        lettered[row[self.folder.fold(points) > 0]] = True
        vectors = np.stack([self._letter(p) for p in used.tolist()])
        turned = np.roll(vectors, 2, 1), np.roll(vectors, 1, 1), vectors

        def bound(grams: np.ndarray) -> np.ndarray:
            return turned[0][grams // side**2] * turned[1][grams // side % side] * turned[2][grams % side]

        distinct = np.zeros(0, np.int64)
        if side**3 <= 1 << 24:
            seen = np.zeros(side**3, bool)
            seen[gram] = True
            distinct = np.flatnonzero(seen)
        if 0 < len(distinct) <= DISTINCT:
            place = np.zeros(side**3, np.int32)
            place[distinct] = np.arange(len(distinct))
            counts = np.bincount(doc * len(distinct) + place[gram], minlength=n * len(distinct))
            out = counts.reshape(n, len(distinct)).astype(np.float32) @ bound(distinct).astype(np.float32)
        else:
            # Many letters: bound vectors are added in text order, some at a time, whatever their variety.
            out = np.zeros((n, self.dimensions), np.float32)
            for lo in range(0, len(gram), AT_ONCE):
                part = doc[lo : lo + AT_ONCE]
                starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                out[part[starts]] += np.add.reduceat(bound(gram[lo : lo + AT_ONCE]), starts, 0, np.int32)
        out[~lettered] = 0
        return out


def _units(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Unit bundles of a batch in parts of bounded size."""
    for part in range(0, batch.num_rows, ROWS):
        rows = batch.slice(part, ROWS)
        for lo, hi, raw, offsets in tb.blocks(rows, "text"):
            bundle = encoder.bundles(raw, offsets)
            norm = np.linalg.norm(bundle, axis=1, keepdims=True)
            yield part + lo, part + hi, bundle / np.where(norm > 0, norm, 1)


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototype of every language; one vector each on the driver."""
    known = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), HELD_OUT)
    )
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(
        *[F.lit(x) for k, n in sizes.items() for x in (k, min(_SHARES, _SHARES * TRAIN_PER_LANG // n + 1))]
    )
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_SHARES)) < share[F.col("lang")])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder(dimensions), {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, units in _units(encoder, batch):
                for lang in set(langs[lo:hi]):
                    part = np.rint(units[langs[lo:hi] == lang].astype(np.float64) * SCALE).sum(0)
                    total[lang] = total.get(lang, 0) + part.astype(np.int64)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions)), pa.array(vector)],
                ["lang", "dim", "value"],
            )

    summed = (
        sample.select(F.col("lang").cast("string"), F.col("text").cast("string"))
        .mapInArrow(sums, "lang string, dim long, value long")
        .groupBy("lang", "dim")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    found: dict[str, np.ndarray] = {}
    for r in summed:
        found.setdefault(r["lang"], np.zeros(dimensions))[r["dim"]] = r["value"]
    norms = {k: np.linalg.norm(v) for k, v in found.items()}
    return {k: found[k] / norms[k] for k in sorted(found) if norms[k] > 0}


def languages(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Language and cosine of every document."""
    known = prototypes(docs, dimensions)
    names = [*known, UNKNOWN]
    matrix = np.stack([*known.values(), np.zeros(dimensions)]).astype(np.float32)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions)
        for batch in batches:
            for lo, hi, units in _units(encoder, batch):
                cosine = units @ matrix.T
                cosine[:, -1] = -2.0
                best = cosine.argmax(1)
                best[(units == 0).all(1)] = len(names) - 1
                score = np.where(
                    best == len(names) - 1, 0.0, np.clip(cosine[np.arange(hi - lo), best], 0, 1)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([names[b] for b in best.tolist()], pa.string()),
                        pa.array(score.astype(np.float64)),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return docs.select(
        F.col("doc_id").cast("long"),
        held_out(F.col("doc_id"), HELD_OUT).alias("held_out"),
        F.col("text").cast("string"),
    ).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
