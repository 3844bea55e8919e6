"""Best-fit packing by exact complements.

Token counts of all documents become a histogram of at most ``SEQUENCE`` lengths. From
the longest length down, the gap beside it is filled exactly: by single lengths, then by pairs and by
triples whose sum is the gap, each combination as often as its lengths are available. Combinations can use
up the short lengths that later gaps need, so each is consumed only as often as best fit of all
that remains needs no more sequences for it: the plan is never worse than best fit alone. What finds no exact filling goes by best
fit, longest first, into the fullest sequence that still holds it. The plan (which lengths share a sequence,
how many times) is a few thousand rows at any input size, and so is the work to make it. Every piece then finds
its place from its rank among the pieces of its length.

Null text counts as empty: one piece, the end id. Longer documents are cut into pieces of
``SEQUENCE``, a shorter one first. Repeated rows are packed each. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from avisgrid.llm import textblocks as tb
from avisgrid.llm.bytepairs import PieceIds
from avisgrid.llm.common import checkpointed

SEQUENCE = 1024
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The token pieces of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceIds(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for lo, hi, raw, offsets in tb.blocks(batch, "text"):
                ids, at = encoder.encode(raw, offsets)
                n = np.diff(at) + 1
                count = -(-n // size)
                row = np.repeat(np.arange(hi - lo), count)
                piece = tb.gathered(np.zeros_like(count), count)
                first = n - (count - 1) * size
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
                length = np.where(piece == 0, first[row], size)
                crc = np.zeros(len(row), np.int64)
                for k, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist())):
                    a, b = at[r] + s, min(at[r] + s + m, at[r + 1])
                    c = zlib.crc32(ids[a:b].astype("<u4").tobytes())
                    crc[k] = zlib.crc32(end.tobytes(), c) if s + m == n[r] else c
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class Plan:
    """Which lengths share a sequence: ``patterns`` holds (lengths, sequences)."""

    def __init__(self, counts: dict[int, int], size: int = SEQUENCE) -> None:
        self.size = size
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._use((size,), int(self.left[size]))
        self._fill_exactly()
        self.patterns += self._best_fit(self.left)
        self.left[:] = 0

    def _times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.left[x]) // lengths.count(x) for x in set(lengths))

    def _use(self, lengths: tuple[int, ...], n: int) -> None:
        if n:
            for x in lengths:
                self.left[x] -= n
            self.patterns.append((lengths, n))

    def _fill_exactly(self) -> None:
        """Singles, then pairs for the gaps that no single length fills, then triples."""
        needed = self._n_best_fit(self.left)
        for find in (self._single_beside, self._pair_beside, self._triple_beside):
            for length in range(self.size - 1, 0, -1):
                while self.left[length] and (lengths := find(length)):
                    n = self._times(lengths)
                    while n:
                        rest = self.left.copy()
                        for x in lengths:
                            rest[x] -= n
                        without = self._n_best_fit(rest)
                        if without + n <= needed:
                            break
                        n //= 8
                    if not n:
                        break
                    self._use(lengths, n)
                    needed = without

    def _single_beside(self, length: int) -> tuple[int, ...] | None:
        both = (length, self.size - length)
        return both if self._times(both) else None

    def _pair_beside(self, length: int) -> tuple[int, ...] | None:
        """The length and a pair that fills its sequence; the larger part as large as possible."""
        gap = self.size - length
        for a in self._pairs(gap):
            if self._times((length, a, gap - a)):
                return (length, a, gap - a)
        return None

    def _triple_beside(self, length: int) -> tuple[int, ...] | None:
        """The length and a triple that fills its sequence, from the sums of two available lengths."""
        gap = self.size - length
        here = (self.left > 0).astype(np.float32)
        sums = np.convolve(here[: gap + 1], here[: gap + 1])[: gap + 1] > 0.5
        firsts = np.flatnonzero((self.left[1:gap] > 0) & sums[gap - 1 : 0 : -1]) + 1
        for a in firsts[::-1].tolist():
            for b in self._pairs(gap - a):
                if b <= a and self._times((length, a, b, gap - a - b)):
                    return (length, a, b, gap - a - b)
        return None

    def _pairs(self, total: int) -> list[int]:
        """Larger parts of the available pairs with this sum, largest first."""
        if total < 2:
            return []
        have = self.left > 0
        larger = np.arange(total - 1, (total + 1) // 2 - 1, -1)
        return larger[have[larger] & have[total - larger]].tolist()

    def _n_best_fit(self, left: np.ndarray) -> int:
        return sum(n for _, n in self._best_fit(left))

    def _best_fit(self, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
        """Sequences for these counts, longest first, into the fullest sequence that still holds a length."""
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap
        gaps: list[int] = []  # of ``open_``, sorted

        def add(lengths: tuple[int, ...], n: int) -> None:
            gap = self.size - sum(lengths)
            if gap not in open_:
                open_[gap] = []
                bisect.insort(gaps, gap)
            open_[gap].append((lengths, n))

        for length in np.flatnonzero(left)[::-1].tolist():
            n = int(left[length])
            while n:
                at = bisect.bisect_left(gaps, length)
                if at == len(gaps):
                    each = self.size // length
                    if n >= each:
                        add((length,) * each, n // each)
                    if n % each:
                        add((length,) * (n % each), 1)
                    break
                gap = gaps[at]
                lengths, there = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
                m = min(n, there)
                if there > m:
                    add(lengths, there - m)
                add((*lengths, length), m)
                n -= m
        return [pattern for found in open_.values() for pattern in found]

    def places(self) -> dict[str, np.ndarray]:
        """Runs of places by length: ranks from ``low`` on go to sequences from ``first`` on."""
        runs, sequence = [], 0
        for lengths, n in self.patterns:
            offset = 0
            for x in lengths:
                runs.append((x, n, sequence, offset))
                offset += x
            sequence += n
        runs.sort()
        run = np.array(runs, np.int64).reshape(-1, 4)
        low = np.cumsum(run[:, 1]) - run[:, 1]
        base = np.zeros(self.size + 2, np.int64)
        np.add.at(base, run[:, 0] + 1, run[:, 1])
        return {"base": np.cumsum(base), "low": low, "first": run[:, 2], "offset": run[:, 3]}


def packed(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Every piece with its sequence and offset."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    cut = checkpointed(pieces(docs, tokenizer, size).withColumn("_part", F.spark_partition_id()))
    by_part = cut.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = by_part.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    counts = cut.groupBy("length").count().collect()  # at most ``size`` rows
    places = Plan({r["length"]: r["count"] for r in counts}, size).places()
    own = W.partitionBy("_part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        cut.withColumn("_rank", F.row_number().over(own) - 1)
        .join(starts, ["_part", "length"])
        .withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            length, rank = (columns[i].to_numpy(zero_copy_only=False) for i in (3, 5))
            at = places["base"][length] + rank
            run = np.searchsorted(places["low"], at, "right") - 1
            sequence = places["first"][run] + at - places["low"][run]
            yield pa.RecordBatch.from_arrays(
                [*columns[:5], pa.array(sequence), pa.array(places["offset"][run])],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
