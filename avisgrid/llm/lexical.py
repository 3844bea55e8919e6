"""Ranked lexical search: every document ranked for each item, TAAT and DAAT in one pass over shards.

Terms are runs of ASCII letters and digits and all non-ASCII characters, A-Z in lower case; a 64-bit hash
stands for a term. Documents become shards of at most ``SHARD_DOCS`` documents or about
``SHARD_POSTINGS`` postings where they lie, each an inverted index of its own in one row; texts do not move.
Statistics (documents, terms, document frequencies) are sums over all shards, so
the number of shards changes no score.

Inside a shard an item's lists are split by length. Short ones, ``SHORT`` postings together, are taken term at
a time: their summed accumulators, in document order and bounded by the largest, are then one iterator
among the long lists. Those are walked document at a time, in windows: only iterators whose bounds together
can reach the item's current k-th score bring candidates, the others are only probed for them, and
candidates whose bound falls short are dropped. The k-th score goes along from shard to shard of a
task. Every task returns its best ``k`` for each item, which meet by slices and then by item.

Items come in blocks of ``ITEMS``, each a pass over the index (not over the texts). Only terms of
items are indexed as long as those are ``VOCABULARY`` at most, else all; results are the same.

Null or wordless texts have no terms, count in no statistic and are never ranked. Equal scores go by
ascending doc_id, nulls last; repeated documents each have a place. Repeated items (same id and text) are
ranked once, items with the same id and other text each. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from avisgrid.llm import textblocks as tb
from avisgrid.llm.common import checkpointed
from avisgrid.session import written

BEST = 10
SHARD_DOCS = 16_384
SHARD_POSTINGS = 1 << 20
SHORT = 4096
WINDOW = 2048  # postings that an iterator brings to a window
ITEMS = 20_000
VOCABULARY = 2_000_000
SLICES = 64  # of a task's best rows of one item, before they meet

_INDEX = "ids binary, nulls binary, sizes binary, terms binary, ends binary, docs binary, tfs binary, n_docs long, n_terms long"
_FOUND = "item long, item_id long, doc_id long, score long"
_KEPT = np.ones(256, bool)
_KEPT[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_KEPT[0x41:0x5B] = True


def term_hashes(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every term. Bytes do for characters: all non-ASCII ones are kept."""
    data = np.frombuffer(raw, np.uint8)
    starts, stops, row = tb.words(_KEPT[data], offsets)
    return tb.span_hashes(tb.fold_ascii(data), starts, stops), row


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Shard:
    """Documents and postings of a shard while it fills."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.n_rows = self.n_postings = self.n_docs = self.n_terms = 0

    def add(self, ids: pa.Array, hashes: np.ndarray, row: np.ndarray, vocabulary: np.ndarray | None) -> None:
        sizes = np.bincount(row, minlength=len(ids))
        self.n_docs += int((sizes > 0).sum())
        self.n_terms += len(hashes)
        terms = np.unique(hashes) if vocabulary is None else vocabulary
        if len(terms) and len(hashes):
            at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
            known = terms[at] == hashes
            pairs, tf = np.unique(row[known] * len(terms) + at[known], return_counts=True)
            self.parts.append((self.n_rows + pairs // len(terms), terms[pairs % len(terms)], tf))
            self.n_postings += len(tf)
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.n_rows += len(ids)

    def full(self) -> bool:
        return self.n_rows >= SHARD_DOCS or self.n_postings >= SHARD_POSTINGS

    def row(self) -> pa.RecordBatch:
        """The shard as one row; documents in the order of ids, those without a posting left out."""
        none = np.zeros(0, np.int64)
        doc, term, tf = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (none, none.astype(np.uint64), none)
        ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], pa.int64())
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        sizes = np.concatenate([*self.sizes, none])
        held = np.unique(doc)
        held = held[np.lexsort((ids[held], nulls[held]))]
        place = np.zeros(len(ids), np.int64)
        place[held] = np.arange(len(held))
        order = np.lexsort((place[doc], term))
        terms, begin = np.unique(term[order], return_index=True)
        columns = [
            ids[held].astype(np.int64),
            nulls[held].astype(np.uint8),
            sizes[held].astype(np.int64),
            terms.astype(np.uint64),
            np.append(begin, len(term))[1:].astype(np.int64),
            place[doc][order].astype(np.int32),
            tf[order].astype(np.int32),
        ]
        values = [pa.array([c.tobytes()], pa.binary()) for c in columns]
        values += [pa.array([n], pa.int64()) for n in (self.n_docs, self.n_terms)]
        return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in _INDEX.split(", ")])


@dataclass
class Postings:
    """A shard as arrays; the list of term i is ``docs[ends[i - 1]:ends[i]]``."""

    ids: np.ndarray
    nulls: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    tfs: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Postings:
        types = (np.int64, np.uint8, np.int64, np.uint64, np.int64, np.int32, np.int32)
        return cls(*(np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in enumerate(types)))


def index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """The documents as shards, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for lo, hi, raw, offsets in tb.blocks(batch, "text"):
                shard.add(batch.column(0).slice(lo, hi - lo), *term_hashes(raw, offsets), shared.value)
                if shard.full():
                    yield shard.row()
                    shard = _Shard()
        if shard.n_rows:
            yield shard.row()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(build, _INDEX), "lexical-index")


def frequencies(shards: DataFrame) -> DataFrame:
    """``term, df`` over all shards; terms are hashes read as signed numbers."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, ends = (np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in ((0, np.int64), (1, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.diff(ends, prepend=0))], ["term", "df"])

    rows = shards.select("terms", "ends").mapInArrow(spelled, "term long, df long")
    return checkpointed(rows.groupBy("term").agg(F.sum("df").alias("df")))


def item_terms(items: DataFrame) -> DataFrame:
    """``term`` of all items, once each."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in tb.blocks(batch, "text"):
                terms = np.unique(term_hashes(raw, offsets)[0])
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64))], ["term"])

    return items.select("text").mapInArrow(spelled, "term long").distinct()


def top(lists: list[tuple[np.ndarray, np.ndarray]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the ``k`` best with at least ``floor``, ties to the smaller document.

    ``lists`` are documents in ascending order with their impacts, all above 0.
    """
    lists = sorted(lists, key=lambda pair: len(pair[0]))
    total = np.cumsum([len(d) for d, _ in lists])
    n_short = int(np.searchsorted(total, SHORT, "right"))
    iterators = lists[n_short:]
    if n_short:
        docs = np.concatenate([d for d, _ in lists[:n_short]])
        summed, at = np.unique(docs, return_inverse=True)
        scores = np.zeros(len(summed), np.int64)
        np.add.at(scores, at, np.concatenate([s for _, s in lists[:n_short]]))
        iterators.append((summed, scores))
    iterators.sort(key=lambda pair: int(pair[1].max()))
    bounds = np.cumsum([int(s.max()) for _, s in iterators])  # of an iterator and all below it
    position = [0] * len(iterators)
    best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while True:
        first = int(np.searchsorted(bounds, floor))  # those below only together stay short of it
        live = [j for j in range(first, len(iterators)) if position[j] < len(iterators[j][0])]
        if not live:
            return best_docs, best
        # The window ends where the first iterator has brought its share.
        stop = min(int(iterators[j][0][min(position[j] + WINDOW, len(iterators[j][0])) - 1]) for j in live) + 1
        brought = []
        for j in live:
            docs, scores = iterators[j]
            end = position[j] + int(np.searchsorted(docs[position[j] : position[j] + WINDOW], stop))
            brought.append((docs[position[j] : end], scores[position[j] : end]))
            position[j] = end
        found, at = np.unique(np.concatenate([d for d, _ in brought]), return_inverse=True)
        score = np.zeros(len(found), np.int64)
        np.add.at(score, at, np.concatenate([s for _, s in brought]))
        for j in range(first - 1, -1, -1):
            able = score + bounds[j] >= floor
            found, score = found[able], score[able]
            docs, scores = iterators[j]
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            score = score + np.where(docs[at] == found, scores[at], 0)
        able = score >= floor
        best_docs = np.concatenate([best_docs, found[able]])
        best = np.concatenate([best, score[able]])
        order = np.lexsort((best_docs, -best))[:k]
        best_docs, best = best_docs[order], best[order]
        if len(best) == k:
            floor = max(floor, int(best[-1]))


class Queries:
    """A block of items: their terms as places in one sorted vocabulary."""

    def __init__(self, ids: list[int | None], texts: list[str | None], first: int) -> None:
        self.ids, self.first = ids, first
        raws = [(t or "").encode() for t in texts]
        each = [np.unique(term_hashes(r, np.array([0, len(r)]))[0]) for r in raws]
        self.terms = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]))
        self.places = [np.searchsorted(self.terms, e) for e in each]
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        for i, term in enumerate(self.terms.view(np.int64).tolist()):
            if term in df:
                self.weights[i] = weight(n_docs, df[term])

    def lists(self, shard: Postings, n_docs: int, n_terms: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The shard's postings with impacts above 0, by place of their term."""
        at = np.searchsorted(shard.terms, self.terms)
        inside = at < len(shard.terms)
        inside[inside] = shard.terms[at[inside]] == self.terms[inside]
        m = 10 + (90 * shard.sizes * n_docs) // n_terms
        found = {}
        for place in np.flatnonzero(inside & (self.weights > 0)).tolist():
            i = int(at[place])
            span = slice(int(shard.ends[i - 1]) if i else 0, int(shard.ends[i]))
            docs, tf = shard.docs[span], shard.tfs[span].astype(np.int64)
            impact = self.weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
            if not impact.all():
                docs, impact = docs[impact > 0], impact[impact > 0]
            if len(docs):
                found[place] = (docs, impact)
        return found


def _best(shards: DataFrame, queries: Queries, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, item_id, doc_id, score``: the best ``k`` of every task for every item."""
    shared = shards.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best: dict[int, list[tuple[int, bool, int]]] = {}  # (-score, id is null, id)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Postings.of(batch, row)
                lists = queries.lists(shard, n_docs, n_terms)
                for q, places in enumerate(queries.places):
                    chosen = [lists[p] for p in places.tolist() if p in lists]
                    if not chosen:
                        continue
                    mine = best.get(q, [])
                    docs, scores = top(chosen, k, -mine[-1][0] if len(mine) == k else 1)
                    if len(docs):
                        new = zip((-scores).tolist(), shard.nulls[docs].astype(bool).tolist(), shard.ids[docs].tolist())
                        best[q] = sorted([*mine, *new])[:k]
        rows = [
            (queries.first + q, queries.ids[q], None if null else i, -s)
            for q, found in best.items()
            for s, null, i in found
        ]
        if rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    narrow = shards.select("ids", "nulls", "sizes", "terms", "ends", "docs", "tfs")
    return narrow.mapInArrow(search, _FOUND)


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    items = checkpointed(items)
    terms = checkpointed(item_terms(items))
    vocabulary = None
    if terms.count() <= VOCABULARY:
        vocabulary = np.sort(terms.toPandas()["term"].to_numpy().astype(np.int64).view(np.uint64))
    shards = index(docs, vocabulary)
    n_docs, n_terms = (int(v or 0) for v in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    df = frequencies(shards)
    blocks = max(1, -(-items.count() // (ITEMS // 2)))  # half full on average; rows are distinct
    spark, first = items.sparkSession, 0
    found = spark.createDataFrame([], _FOUND)
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = rows.orderBy("item_id", "text").collect()
        for lo in range(0, len(rows), ITEMS):
            part = rows[lo : lo + ITEMS]
            queries = Queries([r["item_id"] for r in part], [r["text"] for r in part], first)
            # As many rows as the block has terms.
            own = spark.createDataFrame(pa.table({"term": queries.terms.view(np.int64)}))
            queries.weigh({r["term"]: r["df"] for r in df.join(F.broadcast(own), "term").collect()}, n_docs)
            found = found.union(_best(shards, queries, n_docs, n_terms, k))
            first += len(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    for group in (["item", "slice"], ["item"]):
        sliced = sliced.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
        sliced = sliced.filter(F.col("rank") <= k)
    return sliced.select("item_id", "rank", "doc_id", "score")
