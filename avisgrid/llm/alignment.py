"""Cross-tokenizer alignment: how the tokens of two vocabularies cover the same bytes.

Each text is encoded once by both tokenizers and kept as ids in a table; everything after works
on ids and their byte lengths. Offsets where tokens of both sides end cut the text into groups. The union
of all ends cuts it into stretches, one for each pair of tokens that overlap: the links.

A group of one token on each side with the same bytes needs no pair at all: ``same_bytes`` maps every id of A
to the id of B with these bytes, and such groups are counted in a vector as long as A's vocabulary. Only links of
irregular groups become (pair, count) rows, summed within a task before they are shuffled. The totals come
back the same way: those of equal bytes and the highest of each B id as vectors, those of the ``HEAD``
most frequent other pairs as a sorted array of that size at most; links of rarer pairs meet their totals by a
shuffle on the pair, where no key is frequent.

Texts that are null or empty, or whose bytes one of the tokenizers does not give back, have no tokens and zeros
everywhere. Repeated rows each count. Null ids are carried. Texts are encoded whole, memory
follows the longest one. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avisgrid.llm import textblocks as tb
from avisgrid.llm.bytepairs import PieceIds
from avisgrid.llm.common import bounded_batches
from avisgrid.session import written

HEAD = 500_000  # totals of pairs that tasks hold
TOKENS = 1 << 19  # tokens handled at once, or one text
PAIRS = 1 << 20  # distinct pairs that a task holds before it hands them on
STEPS = 16  # classes of totals by doubling, for the choice of the head

_ENCODED = "row long, doc_id long, a binary, b binary"
_COUNTED = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_TAIL = "tail array<struct<pair: long, times: long, best: long>>"


class Bytes:
    """The bytes of every id, in one pool."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[tb.gathered(self.begin[ids], self.length[ids])]


class Pair:
    """Both tokenizers: encoders, bytes of their ids, and the map of equal bytes."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = PieceIds(path_a)
        self.a.special = {}  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            n_a = max(json.load(f)["model"]["vocab"].values()) + 1
        n_b = self.b.get_piece_size()
        known = set(self.a.bpe.token_byte_values())
        tokens_a = [b""] * n_a
        for token in known:
            tokens_a[self.a.bpe.encode_single_token(token)] = token
        tokens_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(n_b)))
        ]
        self.bytes_a, self.bytes_b = Bytes(tokens_a), Bytes(tokens_b)
        # Pieces before single bytes: a character of its own piece never falls back to bytes.
        by_bytes = {t: i for i, t in reversed(list(enumerate(tokens_b))) if self.b.is_byte(i)}
        by_bytes |= {t: i for i, t in reversed(list(enumerate(tokens_b))) if not self.b.is_byte(i)}
        self.same_bytes = np.array([by_bytes.get(t, -1) if t else -1 for t in tokens_a], np.int64)
        self.n_a, self.n_b = n_a, n_b

    def encode(self, raw: bytes, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of every text on both sides; none where a side does not give its bytes back."""
        filled = np.diff(offsets) > 0
        spaced = np.insert(np.frombuffer(raw, np.uint8), offsets[:-1][filled], 32)
        at = offsets + np.concatenate([[0], np.cumsum(filled)])
        ids_a, at_a = self.a.encode(spaced.tobytes(), at)
        texts = [raw[lo:hi].decode("utf-8") for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        found_b = self.b.encode(texts, num_threads=1)
        found_a = [ids_a[lo:hi].astype(np.int64) for lo, hi in zip(at_a, at_a[1:])]
        found_b = [np.array(ids, np.int64) for ids in found_b]
        none = np.zeros(0, np.int64)
        for k in range(len(filled)):
            text = spaced[at[k] : at[k + 1]]
            whole = filled[k] and all(
                np.array_equal(side.joined(ids), text)
                for side, ids in ((self.bytes_a, found_a[k]), (self.bytes_b, found_b[k]))
            )
            if not whole:
                found_a[k] = found_b[k] = none
        return found_a, found_b


def id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``row, doc_id, a, b``: the ids of every text as binary lists, written once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(path_a, path_b)
        types = [id_type(n) for n in (pair.n_a, pair.n_b)]
        for batch in batches:
            for lo, hi, raw, offsets in tb.blocks(batch, "text"):
                sides = pair.encode(raw, offsets)
                lists = [pa.array([i.astype(t).tobytes() for i in ids], pa.binary()) for ids, t in zip(sides, types)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), *lists], ["row", "doc_id", "a", "b"]
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    return written(rows.mapInArrow(encode, _ENCODED), "token-ids")


class Links:
    """Links of some texts: tokens of both sides, text and group of every link."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, length_a, length_b, same) -> None:
        self.a, self.b, self.n_docs = a, b, len(n_a)
        ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
        both = np.concatenate([ends_a, ends_b])
        both.sort(kind="stable")
        ends = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        self.of_a, self.of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        cut = (ends_a[self.of_a] == ends) & (ends_b[self.of_b] == ends)
        self.group = np.cumsum(cut) - cut
        self.doc_of_a = np.repeat(np.arange(self.n_docs), n_a)
        self.doc = self.doc_of_a[self.of_a]
        alone = cut & np.append(True, cut[:-1])[: len(cut)]
        self.link_a, self.link_b = a[self.of_a], b[self.of_b]
        self.regular = alone & (same[self.link_a] == self.link_b)
        self.n_links = np.bincount(self.doc, minlength=self.n_docs)
        self.n_groups = np.bincount(self.doc[cut], minlength=self.n_docs)

    def spelled(self, digits: Bytes) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for every text."""
        if not len(self.a):
            return [b""] * self.n_docs
        # The group of a token is that of its last link.
        last = lambda of, n: np.searchsorted(of, np.arange(n), "right") - 1
        side = np.concatenate([self.group[last(self.of_a, len(self.a))] * 2, self.group[last(self.of_b, len(self.b))] * 2 + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([self.a, self.b])[order]
        ends = np.cumsum(digits.length[ids])
        out = digits.joined(ids).copy()
        same = np.append(side[1:] == side[:-1], False)
        out[ends - 1] = np.where(same, ord(","), np.where(side % 2 == 0, ord("|"), ord(";")))
        doc_of_group = np.zeros(int(self.group[-1]) + 1, np.int64)
        doc_of_group[self.group] = self.doc
        size = np.bincount(doc_of_group[side // 2], digits.length[ids], self.n_docs).astype(np.int64)
        stop = np.cumsum(size)
        data = out.tobytes()
        return [data[hi - n : hi - 1] if n else b"" for hi, n in zip(stop.tolist(), size.tolist())]


def _blocks(batch: pa.RecordBatch, pair: tuple) -> Iterator[tuple[int, int, Links]]:
    """Links of a batch's rows, about ``TOKENS`` tokens at a time."""
    n_a, n_b, length_a, length_b, same = pair
    k = batch.schema.get_field_index("a")
    a, b = (batch.column(i).cast(pa.large_binary()).to_pylist() for i in (k, k + 1))
    size = np.array([len(x) for x in a], np.int64) // np.dtype(id_type(n_a)).itemsize
    size_b = np.array([len(x) for x in b], np.int64) // np.dtype(id_type(n_b)).itemsize
    done = np.concatenate([[0], np.cumsum(size + size_b)])
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + TOKENS, "right")) - 1)
        ids = [
            np.frombuffer(b"".join(x[lo:hi]), id_type(n)).astype(np.int64) for x, n in ((a, n_a), (b, n_b))
        ]
        yield lo, hi, Links(ids[0], size[lo:hi], ids[1], size_b[lo:hi], length_a, length_b, same)
        lo = hi


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pair, at = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]), return_inverse=True)
    total = np.zeros(len(pair), np.int64)
    np.add.at(total, at, np.concatenate([*counts, np.zeros(0, np.int64)]))
    return pair, total


def pair_counts(ids: DataFrame, pair: tuple) -> DataFrame:
    """``pair, same, n``: all links of every id pair (a times B's vocabulary size, plus b)."""
    n_a, n_b, _, _, same = pair

    def handed(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        equal = same[codes // n_b] == codes % n_b
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(equal), pa.array(n)], ["pair", "same", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regular = np.zeros(n_a, np.int64)
        pairs, counts, held = [], [], 0
        for batch in batches:
            for _, _, links in _blocks(batch, pair):
                regular += np.bincount(links.link_a[links.regular], minlength=n_a)
                odd = ~links.regular
                codes, n = np.unique(links.link_a[odd] * n_b + links.link_b[odd], return_counts=True)
                pairs.append(codes)
                counts.append(n)
                held += len(codes)
                if held > 2 * PAIRS:
                    codes, n = _merged(pairs, counts)
                    pairs, counts, held = [codes], [n], len(codes)
                    if held > PAIRS:
                        yield handed(codes, n)
                        pairs, counts, held = [], [], 0
        at = np.flatnonzero(regular)
        codes, n = _merged([*pairs, at * n_b + same[at]], [*counts, regular[at]])
        if len(codes):
            yield handed(codes, n)

    rows = ids.select("a", "b").mapInArrow(count, "pair long, same boolean, n long")
    return written(rows.groupBy("pair", "same").agg(F.sum("n").alias("n")), "pair-counts")


def head(counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The most frequent pairs of unequal bytes, at most ``most``, and whether these are all."""
    other = counts.filter("NOT same")
    step = F.floor(F.log2("n") * STEPS)
    # A few hundred classes at most.
    sizes = other.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    room, least = most, None
    for r in sizes:
        room -= r["count"]
        if room < 0:
            return (other.filter(step >= least) if least is not None else other.limit(0)), False
        least = r["step"]
    return other, True


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most: int | None = None) -> DataFrame:
    """Token, group and link counts of every text, and how frequent its links are corpus-wide."""
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    bounded_batches(docs.sparkSession)
    both = Pair(path_a, path_b)
    pair = (both.n_a, both.n_b, both.bytes_a.length, both.bytes_b.length, both.same_bytes)
    n_b = both.n_b
    ids = encoded(docs, path_a, path_b)
    counts = pair_counts(ids, pair)
    # One row for each id of B and of A at most.
    best = np.zeros(n_b, np.int64)
    for r in counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("n")).collect():
        best[r["b"]] = r["n"]
    equal = np.zeros(both.n_a, np.int64)
    for r in counts.filter("same").collect():
        equal[r["pair"] // n_b] = r["n"]
    frequent, whole = head(counts, HEAD if most is None else most)
    table = frequent.select("pair", "n").toArrow()  # HEAD rows at most
    known, total = (table.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    order = np.argsort(known)
    digits = Bytes([b"%d," % i for i in range(max(both.n_a, n_b))])
    shared = docs.sparkSession.sparkContext.broadcast((pair, known[order], total[order], equal, best, digits))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, known, total, equal, best, digits = shared.value
        same = pair[4]
        for batch in batches:
            for lo, hi, links in _blocks(batch, pair):
                codes, at = np.unique(links.link_a * n_b + links.link_b, return_inverse=True)
                a, b = codes // n_b, codes % n_b
                place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                found = known[place] == codes if len(known) else np.zeros(len(codes), bool)
                n = np.where(found, total[place], 0) if len(known) else np.zeros(len(codes), np.int64)
                n = np.where(same[a] == b, equal[a], n)
                is_best = (n == best[b]) & (n > 0)
                best_links = np.bincount(links.doc[is_best[at]], minlength=links.n_docs)
                count_sum = np.zeros(links.n_docs, np.int64)
                np.add.at(count_sum, links.doc, n[at])
                rare = n[at] == 0
                row_pairs, times = np.unique(links.doc[rare] * len(codes) + at[rare], return_counts=True)
                of, which = (row_pairs // len(codes), row_pairs % len(codes)) if len(codes) else (row_pairs, row_pairs)
                tail = pa.StructArray.from_arrays(
                    [pa.array(codes[which]), pa.array(times.astype(np.int64)), pa.array(best[b[which]])],
                    ["pair", "times", "best"],
                )
                tail = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(links.n_docs + 1)), pa.int32()), tail
                )
                spelled = links.spelled(digits)
                sizes = [np.bincount(links.doc_of_a, minlength=links.n_docs)]
                bounds = np.flatnonzero(np.append(True, links.doc[1:] != links.doc[:-1])[: len(links.doc)])
                n_of_b = np.zeros(links.n_docs, np.int64)
                if len(bounds):
                    first = links.of_b[bounds]
                    n_of_b[links.doc[bounds]] = np.diff(np.append(first, len(links.b)))
                sizes += [n_of_b, links.n_groups, links.n_links, best_links, count_sum]
                sha = [hashlib.sha256(s).hexdigest() if s else "" for s in spelled]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(lo, hi - lo) for k in (0, 1)),
                        *(pa.array(s.astype(np.int64)) for s in sizes),
                        pa.array(sha, pa.string()),
                        tail,
                    ],
                    ["row", "doc_id", *(c.split()[0] for c in _COUNTED.split(", ")), "tail"],
                )

    found = ids.mapInArrow(describe, f"row long, doc_id long, {_COUNTED}, {_TAIL}")
    columns = ["doc_id", *(c.split()[0] for c in _COUNTED.split(", "))]
    if whole:
        return found.select(*columns)
    found = written(found, "alignments")
    rare = found.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(counts.select("pair", "n"), "pair")
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("times")).alias("more"),
    )
    merged = found.join(sums, "row", "left").withColumns(
        {
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)),
        }
    )
    return merged.select(*columns)
