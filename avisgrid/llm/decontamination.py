"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

Test items are the indexed side. Impacts are BM25 weights divided by the item's score
against itself, so 1 means that a passage holds all of an item's words. Documents are cut
into passages that overlap by the longest item, so an item of the document lies whole in
one of them; every passage queries the index for all items above ``THRESHOLD``. Summed maxima
of the passage's terms find the blocks of items that can reach it at all; WAND, bounded by
the same maxima, walks the posting lists in those. A retrieved item counts as leaked when
both its question (the words before the last quarter) and its answer (the last quarter) share
at least ``OVERLAP`` of their five-word runs with the document, or of their words when aligned with it: one less
the edits of words (substitution, gap, insertion) from the nearest part of the passage, by word of the part. Parts of
less than ``ALIGNED`` words are compared whole, since one common word would be half of them.

Items come in index blocks of ``ITEMS`` at most, each broadcast with the task; more items mean
more passes over the documents, never a larger index. Document frequencies, number, mean length and longest
item are those of all items, counted once in Spark, so no score depends on the blocks. Words are runs of letters and
digits in lower case. Null or wordless texts and items match nothing; repeated
items are indexed once and count each under its id; a null id is carried. Empty tables give no leaks.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avisgrid.llm import textblocks as tb
from avisgrid.llm.common import checkpointed, map_rows

THRESHOLD = 0.5
OVERLAP = 0.5
RUN = 5
ALIGNED = 3  # words of the shortest part that is aligned
ITEMS = 20_000
BLOCK = 4  # items that share one maximum for each term
K1, B = 1.2, 0.75

Hit = tuple[int, float]


def _aligned(part: np.ndarray, words: np.ndarray) -> float:
    """One less the edits between the part and the nearest stretch of the words, by word of the part."""
    at = np.arange(len(words) + 1)
    edits = np.zeros(len(words) + 1, np.int64)
    for n, word in enumerate(part, 1):
        either = np.minimum(edits[:-1] + (words != word), edits[1:] + 1)
        edits = np.minimum.accumulate(np.append(n, either) - at) + at
    return 1 - int(edits.min()) / len(part)


@dataclass(frozen=True)
class Statistics:
    """Numbers of all items: how many, words in the longest and on average, items that hold a word."""

    n_items: int
    span: int
    mean: float
    df: dict[int, int]  # of the words of a block at least

    @classmethod
    def of(cls, words: list[list[int]]) -> Statistics:
        total = sum(map(len, words))
        df = Counter(t for w in words for t in set(w))
        return cls(len(words), max(map(len, words), default=0), max(1.0, total / max(1, len(words))), df)


def _words_of(texts: list[str | None]) -> list[list[int]]:
    """Word hashes of every text."""
    raws = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    hashes, _, _, row = tb.word_hashes(tb.Folder(str.isalnum), b"".join(raws), offsets)
    at = np.searchsorted(row, np.arange(len(raws) + 1))
    return [hashes[a:b].tolist() for a, b in zip(at, at[1:])]


class Index:
    """Posting lists with impacts and block maxima, and the runs of every item."""

    def __init__(
        self,
        items: list[tuple[int | None, str | None]],
        all_items: Statistics | None = None,
        copies: list[int] | None = None,
    ) -> None:
        """``all_items``: by default the items given are all there are, each once."""
        self.copies = copies or [1] * len(items)
        self.ids = [i for i, _ in items]
        words = _words_of([t for _, t in items])
        known = all_items or Statistics.of(words)
        self.span = known.span
        self.runs = [self._parts(w) for w in words]
        self.parts = [tuple(np.array(p, np.uint64) for p in self._halves(w)) for w in words]
        counts = [Counter(w) for w in words]
        df, n_items = known.df, known.n_items
        postings: dict[int, list[Hit]] = {t: [] for c in counts for t in c}
        for i, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(words[i]) / known.mean)
            weight = {
                t: math.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm)
                for t, n in c.items()
            }
            whole = sum(weight.values())
            for t, w in weight.items():
                postings[t].append((i, w / whole))
        self.terms = np.array(sorted(postings), np.uint64)
        self.items = [[i for i, _ in postings[t]] for t in self.terms.tolist()]
        self.impacts = [[w for _, w in postings[t]] for t in self.terms.tolist()]
        self.largest = np.array([max(w) for w in self.impacts] + [0.0])
        # Largest impact of every term in every block of items that holds it.
        self.n_blocks = -(-len(items) // BLOCK)
        self.maxima: list[dict[int, float]] = []
        for found, weights in zip(self.items, self.impacts):
            most: dict[int, float] = {}
            for i, w in zip(found, weights):
                most[i // BLOCK] = max(w, most.get(i // BLOCK, 0.0))
            self.maxima.append(most)
        self.length = np.array([len(m) for m in self.maxima], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.block = np.array([k for m in self.maxima for k in m], np.int64)
        self.block_max = np.array([w for m in self.maxima for w in m.values()])

    @staticmethod
    def _halves(words: list[int]) -> tuple[list[int], list[int]]:
        """Question and answer."""
        cut = len(words) - max(1, len(words) // 4) if len(words) > 1 else 0
        return words[:cut], words[cut:]

    @classmethod
    def _parts(cls, words: list[int]) -> tuple[set[tuple], set[tuple], int, int]:
        """Runs of question and answer, and their lengths; short parts are one run."""
        question, answer = cls._halves(words)
        kq, ka = min(RUN, len(question)), min(RUN, len(answer))

        def runs(w: list[int], k: int) -> set[tuple]:
            return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()

        return runs(question, kq), runs(answer, ka), kq, ka

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term of every word; the number of terms for words that occur in no item."""
        at = np.searchsorted(self.terms, hashes)
        found = np.zeros(len(hashes), bool)
        inside = at < len(self.terms)
        found[inside] = self.terms[at[inside]] == hashes[inside]
        return np.where(found, at, len(self.terms))

    def live_blocks(self, terms: list[int], threshold: float = THRESHOLD) -> list[int]:
        """Blocks whose summed maxima over distinct ``terms`` reach the threshold."""
        chosen = np.array(terms, np.int64)
        entries = tb.gathered(self.begin[chosen], self.length[chosen])
        bound = np.bincount(self.block[entries], self.block_max[entries], self.n_blocks)
        return np.flatnonzero(bound >= threshold - 1e-9).tolist()

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[Hit]:
        """All items whose summed impacts over distinct ``terms`` reach the threshold."""
        return [h for k in self.live_blocks(terms, threshold) for h in self._wand(terms, k, threshold)]

    def _wand(self, terms: list[int], block: int, threshold: float) -> list[Hit]:
        """Walk the posting lists of one block, skipping to the first item that can reach it."""
        slack, end = threshold - 1e-9, (block + 1) * BLOCK
        cursors = []  # item, bound, term, position
        for t in terms:
            if block in self.maxima[t]:
                p = bisect.bisect_left(self.items[t], block * BLOCK)
                cursors.append([self.items[t][p], self.maxima[t][block], t, p])
        hits: list[Hit] = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[1]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0]
            if cursors[0][0] == target:
                here = [c for c in cursors if c[0] == target]
                score = sum(self.impacts[c[2]][c[3]] for c in here)
                if score >= slack:
                    hits.append((target, score))
                target += 1
            for c in cursors:
                if c[0] >= target:
                    break
                postings = self.items[c[2]]
                c[3] = bisect.bisect_left(postings, target, c[3])
                c[0] = postings[c[3]] if c[3] < len(postings) else end
            cursors = [c for c in cursors if c[0] < end]
        return hits

    def verify(self, item: int, words: list[int]) -> tuple[float, float]:
        """Shares of the question and the answer that the words hold: of runs or of aligned words."""
        question, answer, kq, ka = self.runs[item]
        shares = []
        for runs, k, part in zip((question, answer), (kq, ka), self.parts[item]):
            here = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if k else set()
            share = len(runs & here) / len(runs) if runs else 1.0
            if share < 1 and len(part) >= ALIGNED:
                share = max(share, _aligned(part, np.array(words, np.uint64)))
            shares.append(share)
        return shares[0], shares[1]

    def leaks(self, terms: np.ndarray, hashes: np.ndarray) -> list[tuple[int, float, float, float]]:
        """Leaked items of one document: item, score, question and answer overlap."""
        n, step = len(terms), max(1, self.span)
        known = np.concatenate([[0.0], np.cumsum(self.largest[terms])])
        begin = np.arange(0, max(1, n - step), step)
        end = np.minimum(begin + 2 * step, n)
        found: dict[int, tuple[float, float, float]] = {}
        for a, b in zip(begin, end):
            if known[b] - known[a] < THRESHOLD - 1e-9:
                continue
            distinct = [t for t in set(terms[a:b].tolist()) if t < len(self.terms)]
            for item, score in self.search(distinct):
                question, answer = self.verify(item, hashes[a:b].tolist())
                if min(question, answer) >= OVERLAP and score > found.get(item, (0.0,))[0]:
                    found[item] = (score, question, answer)
        return [(i, *v) for i, v in sorted(found.items())]


def _spelled(items: DataFrame) -> DataFrame:
    """``term, copies, n``: a row for each item and distinct word, and one without word that has the item's length."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, copies in zip(_words_of(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                terms = np.array(list(set(words)), np.uint64).view(np.int64).tolist()
                columns = [None, *terms], [copies] * (1 + len(terms)), [len(words), *[1] * len(terms)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["term", "copies", "n"])

    return items.select("text", "copies").mapInArrow(spell, "term long, copies long, n long")


def indexes(items: DataFrame) -> Iterator[Index]:
    """The items in index blocks of bounded size; the number of blocks follows the table."""
    items = items.groupBy(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = checkpointed(items.agg(F.count(F.lit(1)).alias("copies")))
    terms = _spelled(items).groupBy("term").agg(
        F.sum("copies").alias("df"), F.sum(F.col("copies") * F.col("n")).alias("words"), F.max("n").alias("span")
    )
    terms = checkpointed(terms)
    whole = terms.where("term IS NULL").first()
    if whole is None:
        return
    spark, mean = items.sparkSession, max(1.0, whole["words"] / whole["df"])
    blocks = -(-items.count() // (ITEMS // 2))  # half full on average
    for k in range(blocks):
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k
        rows = items.filter(block).orderBy("item_id", "text").collect()
        for lo in range(0, len(rows), ITEMS):
            part = rows[lo : lo + ITEMS]
            own = np.array(sorted({t for w in _words_of([r["text"] for r in part]) for t in w}), np.uint64)
            # As many rows as the block has words.
            mine = terms.join(F.broadcast(spark.createDataFrame(pa.table({"term": own.view(np.int64)}))), "term")
            df = {r["term"] % (1 << 64): r["df"] for r in mine.select("term", "df").collect()}
            known = Statistics(whole["df"], whole["span"], mean, df)
            yield Index([(r["item_id"], r["text"]) for r in part], known, [r["copies"] for r in part])


def _scan(batch: pa.RecordBatch, index: Index, folder: tb.Folder) -> Iterator[tuple[int, list]]:
    """Leaked items of every row of a batch that has any."""
    for lo, hi, raw, offsets in tb.blocks(batch, "text"):
        hashes, _, _, row = tb.word_hashes(folder, raw, offsets)
        terms = index.lookup(hashes)
        at = np.searchsorted(row, np.arange(hi - lo + 1))
        weight = np.concatenate([[0.0], np.cumsum(index.largest[terms])])
        for k in np.flatnonzero(weight[at[1:]] - weight[at[:-1]] >= THRESHOLD - 1e-9).tolist():
            if leaks := index.leaks(terms[at[k] : at[k + 1]], hashes[at[k] : at[k + 1]]):
                yield lo + k, leaks


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Leaked items: one row for a document and item."""
    columns = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame([], columns)
    for index in indexes(items):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            folder = tb.Folder(str.isalnum)
            for batch in batches:
                rows = [
                    (k, *leak)
                    for k, all_ in _scan(batch, index, folder)
                    for leak in all_
                    for _ in range(index.copies[leak[0]])
                ]
                if rows:
                    at, item, *numbers = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(at)),
                            pa.array([index.ids[i] for i in item], pa.int64()),
                            *[pa.array(x, pa.float64()) for x in numbers],
                        ],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        found = found.union(texts.mapInArrow(search, columns))
    return found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a leaked item, all columns kept; needs a column ``text``."""
    for index in indexes(items):

        def keep(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            folder = tb.Folder(str.isalnum)
            for batch in batches:
                clean_rows = np.ones(batch.num_rows, bool)
                clean_rows[[k for k, _ in _scan(batch, index, folder)]] = False
                yield batch.filter(pa.array(clean_rows))

        docs = map_rows(docs, keep)
    return docs
