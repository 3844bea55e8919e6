"""Near-duplicate groups by Order MinHash.

Texts become runs of ``SHINGLE`` folded words (letters and digits in lower case), each labelled with
its occurrence in the text. A sketch takes the ``KEPT`` smallest labelled runs under one hash
and keeps their text order, so two texts agree in it only if they share these runs in the
same order; there are ``SKETCHES`` of them. As many take the smallest distinct runs without their order, for
texts whose blocks moved or are repeated. If one of two texts repeats no run, their distinct runs are at least as
similar as the labelled ones, so only texts with repeated runs need the ordered sketches too. Where s of u runs are shared, in order or distinct, a sketch agrees
with probability C(s, KEPT) / C(u, KEPT); that none does at a similarity of 0.8 has a chance below five in a
million at 21 runs and below one in a million from 100 runs.
Texts of up to ``FEW`` runs, and those that can be similar to them, have keys that meet for certain.

Exact copies are one class from the start. Classes that agree in a sketch meet in a bucket, and each is
compared with the bucket's hub: its first class in an order by hash of the class alone, so that a group has few
hubs however many buckets it fills. After the components of those links are known, only buckets whose
classes still lie in different components meet hubs of another order, ``ORDERS`` in all; before the last one a
class takes only the hub that it shares the most buckets with. What lies apart in a bucket even then is compared in full: in small buckets pair by pair, in large ones (thousands of copies of one
text with similarities around the threshold) block by block, with one array operation for all pairs
of two blocks. No link between components is lost, and no bucket's pairs become rows.

Comparison is an alignment of the labelled runs inside the band that a similarity of
``SIMILARITY`` allows: the longest common chain in text order. Similarity is the share of aligned runs
among all, or the Jaccard similarity of the distinct runs where blocks moved and that is larger.

A text of fewer words is one run; texts without words are alike only if they are equal. Null counts as
empty. Null ids come last in a group. Repeated rows are members of their own. An empty
table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avisgrid.llm import textblocks as tb
from avisgrid.llm.common import checkpointed, free_name, own_columns, sized
from avisgrid.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
KEPT = 5
SKETCHES = 36
FEW = 20  # runs of a text that is found for certain
FULL = 3  # runs of a part that are a key by themselves
ORDERS = 3  # of hubs, before all classes of a bucket that still lie apart are compared
HUB_ROWS = 64  # pairs of a hub that meet in one place
CROWD = 16  # classes of a bucket that are still compared pair by pair
BLOCK = 256
PARTITIONS = 16  # of keys and pairs at least, and their rows in a partition; short tables take few tasks, whatever
PART_ROWS = 50_000  # the session's number of partitions is
LISTED = 1_000  # texts in a partition of word lists
_AT_ONCE = 1 << 21  # hashes held for one text


def _shingles(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word runs and the text of each; a short text is one run."""
    if not len(h):
        return h, row
    first = np.searchsorted(row, np.arange(n + 1))
    length = np.diff(first)
    begin = tb.gathered(first[:-1], np.where(length > 0, np.maximum(length - SHINGLE + 1, 1), 0))
    run = np.zeros(len(begin), np.uint64)
    for j in range(SHINGLE):
        at = begin + j
        inside = at < first[row[begin] + 1]
        word = np.where(inside, h[np.minimum(at, len(h) - 1)], np.uint64(j + 1))
        run = tb.mixed(run * np.uint64(0x9FB21C651E98DF25) + word)
    return run, row[begin]


def _labelled(run: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Runs with their occurrence in the text mixed in."""
    order = np.lexsort((run, row))
    new = np.ones(len(run), bool)
    new[1:] = (run[order][1:] != run[order][:-1]) | (row[order][1:] != row[order][:-1])
    start = np.flatnonzero(new)
    occurrence = np.empty(len(run), np.uint64)
    occurrence[order] = np.arange(len(run)) - np.repeat(start, np.diff(np.append(start, len(run))))
    return tb.mixed(run + occurrence * np.uint64(0x9E3779B97F4A7C15))


_FACTORS = np.random.default_rng(4321).integers(1, 1 << 63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.uint64(0x9FB21C651E98DF25)


def _minima(x: np.ndarray) -> np.ndarray:
    """Places of the ``KEPT`` smallest runs under every hash, in text order."""
    at = np.empty((SKETCHES, KEPT), np.int64)
    step = max(1, _AT_ONCE // len(x))
    for lo in range(0, SKETCHES, step):
        values = x * _FACTORS[lo : lo + step, None]
        at[lo : lo + step] = np.sort(np.argpartition(values, KEPT - 1, axis=1)[:, :KEPT], axis=1)
    return at


def _sketches(chosen: np.ndarray, first: int) -> np.ndarray:
    """Bucket keys of the chosen runs of every hash, numbered from ``first``."""
    key = np.arange(first, first + len(chosen), dtype=np.uint64)
    for k in range(chosen.shape[1]):
        key = tb.mixed(key * _FOLD + chosen[:, k])
    return key


def _exact_keys(x: np.ndarray) -> np.ndarray:
    """Bucket keys of a small set of runs; any two sets at ``SIMILARITY`` have one in common.

    Sets of a and b runs differ in k runs at most, so of k + 1 parts by hash one is the same in both:
    its runs are the key. Parts of less than ``FULL`` runs say little; they are joined with
    each of the first runs outside of them, so many that a common one is among those.
    """
    x = np.sort(x)
    n, least = len(x), int(np.ceil(SIMILARITY * len(x) - 1e-9))
    most = int(n / SIMILARITY + 1e-9) if n <= FEW else FEW
    share = (1 - SIMILARITY) / (1 + SIMILARITY)
    spread, keys = tb.mixed(x * _FOLD), []
    for m in sorted({int(share * (n + other) + 1e-9) + 1 for other in range(least, most + 1)}):
        part = (x % np.uint64(m)).astype(np.int64)
        whole = np.arange(m, dtype=np.uint64) + np.uint64(m << 32)
        np.add.at(whole, part, spread)
        whole = tb.mixed(whole)
        full = (np.bincount(part, minlength=m) >= FULL) | (m == 1)
        keys.append(whole[full])
        for i in np.flatnonzero(~full).tolist():
            keys.append(tb.mixed(whole[i : i + 1] * _FOLD + x[part != i][: n - least + 1]))
    return np.concatenate(keys)


def _keys(x: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Bucket keys of one text's labelled runs, and of those that occur for the first time."""
    found = []
    repeats = len(distinct) < len(x)
    if repeats and len(x) > FEW:
        found.append(_sketches(x[_minima(x)], 0))
    if len(distinct) > FEW:
        found.append(_sketches(np.sort(distinct[_minima(distinct)], axis=1), SKETCHES))
    for runs in (x, distinct) if repeats else (x,):
        if len(runs) <= FEW / SIMILARITY:
            found.append(_exact_keys(runs))
    return np.unique(np.concatenate(found)).view(np.int64)


def _folder() -> tb.Folder:
    return tb.Folder(str.isalnum)


def text_class() -> Column:
    """Sixteen bytes that stand for the exact text."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, cid, keys`` of every row; no keys without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _folder()
        for batch in batches:
            for lo, hi, raw, offsets in tb.blocks(batch, "text"):
                h, _, _, row = tb.word_hashes(folder, raw, offsets)
                run, row = _shingles(h, row, hi - lo)
                x = _labelled(run, row)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                first = x == tb.mixed(run)  # the label of a first occurrence
                keys = [
                    _keys(x[a:b], x[a:b][first[a:b]]) if b > a else np.zeros(0, np.int64)
                    for a, b in zip(at, at[1:])
                ]
                sizes = [len(k) for k in keys]
                flat = np.concatenate(keys)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists],
                    ["doc_id", "cid", "keys"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long"), text_class().alias("cid"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(sketch, "doc_id long, cid binary, keys array<long>")


def aligned(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two texts given as word hashes."""
    runs, labels = [], []
    for words in (x, y):
        row = np.zeros(len(words), np.int64)
        run, row = _shingles(words, row, 1)
        runs.append(run)
        labels.append(_labelled(run, row))
    a, b = labels
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    band = (1 / SIMILARITY - 1) * min(len(a), len(b)) + 1
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) and (np.diff(j) > 0).all():
        chain = len(j)
    else:
        tails: list[int] = []  # of increasing chains, by length
        for v in j.tolist():
            k = bisect.bisect_left(tails, v)
            tails[k : k + 1] = [v]
        chain = len(tails)
    order_aware = chain / (len(a) + len(b) - chain)
    if order_aware >= SIMILARITY:
        return order_aware
    p, q = np.unique(runs[0]), np.unique(runs[1])
    common = len(np.intersect1d(p, q, assume_unique=True))
    return max(order_aware, common / (len(p) + len(q) - common))


def _word_lists(docs: DataFrame, needed: DataFrame, n_needed: int) -> DataFrame:
    """``cid, words`` (32-bit hashes) of the needed classes, once each."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _folder()
        for batch in batches:
            for lo, hi, raw, offsets in tb.blocks(batch, "text"):
                h, _, _, row = tb.word_hashes(folder, raw, offsets)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([h[a:b].astype(np.uint32).tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                    ],
                    ["cid", "words"],
                )

    texts = docs.select(text_class().alias("cid"), F.col("text").cast("string").alias("text"))
    texts = texts.join(sized(needed, n_needed), "cid", "left_semi")
    lists = texts.mapInArrow(hashed, "cid binary, words binary")
    return checkpointed(lists.groupBy("cid").agg(F.first("words").alias("words")))


def _words(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, np.uint32).astype(np.uint64)


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs of classes that are similar enough; ``b`` may be in many pairs, ``a`` in few."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            alike = [aligned(_words(p), _words(q)) for p, q in zip(x, y)]
            rows = batch.select([0, 1]).append_column("similarity", pa.array(alike, pa.float64()))
            yield rows.filter(pa.array([s >= SIMILARITY for s in alike]))

    left = words.select(F.col("cid").alias("a"), F.col("words").alias("x"))
    right = words.select(F.col("cid").alias("b"), F.col("words").alias("y"))
    # A hub's words go to as many places as its pairs need.
    places = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("places"))
    spread = places.select("b", "places", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    right = spread.select("b", "place").join(right, "b")
    dealt = pairs.join(places, "b").withColumn("place", F.pmod(F.xxhash64("a"), F.col("places")).cast("int"))
    both = dealt.select("a", "b", "place").join(left, "a").join(right, ["b", "place"]).select("a", "b", "x", "y")
    return checkpointed(both.mapInArrow(verify, "a binary, b binary, similarity double"))


def _placed(shared: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """``key, cid, label, n`` of the buckets whose classes lie in several components."""
    placed = shared.join(labels.withColumnRenamed("node", "cid"), "cid", "left").coalesce(parts)
    placed = placed.select("key", "cid", F.coalesce("label", "cid").alias("label"))
    mixed = placed.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    return checkpointed(placed.join(mixed.filter("lo <> hi").select("key", "n"), "key").coalesce(parts))


def _hub_pairs(placed: DataFrame, order: int, parts: int) -> DataFrame:
    """``a, b``: classes with hubs of their buckets in other components.

    Before the last order that is the hub a class shares the most buckets with, so that it takes one
    alignment; the last order takes all of them.
    """
    place = F.struct(F.xxhash64(F.lit(order), "cid").alias("h"), F.col("cid").alias("hub"), F.col("label").alias("at"))
    hub = placed.groupBy("key").agg(F.min(place).alias("m")).select("key", "m.hub", "m.at")
    met = placed.join(hub, "key").filter("label <> at").coalesce(parts)
    met = met.groupBy(F.col("cid").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    if order == ORDERS - 1:
        return met.select("a", "b").coalesce(parts)
    most = F.max(F.struct("n", F.xxhash64("b").alias("h"), "b")).alias("m")
    return met.coalesce(parts).groupBy("a").agg(most).select("a", F.col("m.b").alias("b")).coalesce(parts)


def linked_classes(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Verified links between classes and their components; None without any candidate."""
    classes = rows.groupBy("cid").agg(F.first("keys").alias("keys"))
    member = classes.select("cid", F.explode("keys").alias("key"))
    several = member.groupBy("key").count().filter("count > 1")
    shared = checkpointed(member.join(several.select("key"), "key"))
    parts = max(PARTITIONS, shared.count() // PART_ROWS)
    shared = shared.coalesce(parts)
    needed = checkpointed(shared.select("cid").distinct().coalesce(parts))
    n_needed = needed.count()
    if not n_needed:
        return None
    words = _word_lists(docs, needed, n_needed).coalesce(max(PARTITIONS, n_needed // LISTED))
    placed, links, pairs, labels = shared.withColumn("label", F.col("cid")), None, None, None
    for order in range(ORDERS):
        if labels is not None:
            placed = _placed(shared, labels, parts)
        found = _hub_pairs(placed, order, parts)
        if pairs is not None:
            found = found.join(pairs, ["a", "b"], "left_anti").coalesce(parts)
        found = checkpointed(found)
        more = _verified(found, words).select("a", "b").coalesce(parts)
        if links is None:
            pairs, links = found, more
        elif more.isEmpty():
            pairs = pairs.union(found)
            continue
        else:
            pairs, links = pairs.union(found), links.union(more)
        labels = components(links)
    # Buckets whose members still lie in several components: all pairs between those.
    placed = _placed(shared, labels, parts)
    few = placed.filter(F.col("n") <= CROWD)
    other = few.select("key", F.col("cid").alias("cid2"), F.col("label").alias("label2"))
    rest = few.join(other, "key").filter("label <> label2 AND cid < cid2")
    rest = rest.select(F.col("cid").alias("a"), F.col("cid2").alias("b")).distinct()
    either = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = rest.coalesce(parts).join(either.coalesce(parts), ["a", "b"], "left_anti").coalesce(parts)
    more = _verified(checkpointed(rest), words).select("a", "b").coalesce(parts)
    many = placed.filter(F.col("n") > CROWD)
    if not many.isEmpty():
        more = more.union(_crowd_links(many, words))
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    return links, labels


def _crowd_links(placed: DataFrame, words: DataFrame) -> DataFrame:
    """Links between components inside large buckets, without a row for each pair.

    Large buckets that share members form a crowd. Its members outside the largest component
    meet all members, block by block: every task gets two blocks of ``BLOCK`` texts at most.
    """
    hub = placed.groupBy("key").agg(F.min("cid").alias("hub"))
    spokes = placed.join(hub, "key").filter("cid <> hub")
    crowd = components(spokes.select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    crowd = crowd.select(F.col("node").alias("cid"), F.col("label").alias("crowd"))
    members = checkpointed(placed.select("cid", "label").distinct().join(crowd, "cid"))
    sizes = members.groupBy("crowd", "label").count().groupBy("crowd")
    sizes = sizes.agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select(
        "crowd",
        F.col("m.label").alias("major"),
        blocks(F.col("n")).alias("n_all"),
        blocks(F.col("n") - F.col("m.count")).alias("n_minor"),
    )
    dealt = members.join(sizes, "crowd").join(words, "cid")
    place = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = dealt.filter("label <> major").withColumn("i", place(F.col("n_minor")))
    keys = ("crowd", "i", "j")
    fresh = [F.col(c).alias(c) for c in (*keys, "cid", "label", "words")]  # both sides have the same source
    minor = minor.withColumn("j", each("n_all")).select(*fresh)
    all_ = dealt.withColumn("j", place(F.col("n_all"))).withColumn("i", each("n_minor")).select(*fresh)
    met = minor.groupBy(*keys).cogroup(all_.groupBy(*keys))
    return checkpointed(met.applyInArrow(_block_links, "a binary, b binary"))


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """One link for every two components that a pair of the blocks links."""
    sides = []
    for side in (left, right):
        words = [_words(w) for w in side.column("words").to_pylist()]
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        run, row = _shingles(np.concatenate([*words, np.zeros(0, np.uint64)]), row, len(words))
        sides.append((words, side.column("cid").to_pylist(), side.column("label").to_pylist(), run, row))
    found: dict[tuple, tuple] = {}
    (xs, x_ids, x_labels, x_run, x_row), (ys, y_ids, y_labels, y_run, y_row) = sides
    shape = (len(xs), len(ys))
    if 0 not in shape:
        near = np.zeros(shape, bool)
        for labelled in (True, False):
            kinds = []
            for run, row in ((x_run, x_row), (y_run, y_row)):
                if labelled:
                    run = _labelled(run, row)
                else:
                    order = np.lexsort((run, row))
                    run, row = run[order], row[order]
                    new = np.append(True, (run[1:] != run[:-1]) | (row[1:] != row[:-1]))[: len(run)]
                    run, row = run[new], row[new]
                kinds.append((run, row))
            near |= _overlap(*kinds, shape) >= SIMILARITY - 1e-9
        for i, j in np.argwhere(near).tolist():
            pair = (x_labels[i], y_labels[j])
            if pair[0] != pair[1] and pair not in found and aligned(xs[i], ys[j]) >= SIMILARITY:
                found[pair] = (x_ids[i], y_ids[j])
    a, b = zip(*found.values()) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _overlap(x: tuple, y: tuple, shape: tuple[int, int]) -> np.ndarray:
    """Jaccard similarities of all pairs, from runs that occur once in their text."""
    (x_run, x_row), (y_run, y_row) = x, y
    order = np.argsort(x_run, kind="stable")
    lo, hi = (np.searchsorted(x_run[order], y_run, side) for side in ("left", "right"))
    common = np.zeros(shape[0] * shape[1], np.int64)
    step = max(1, _AT_ONCE // max(1, shape[0]))
    for k in range(0, len(y_run), step):
        n = hi[k : k + step] - lo[k : k + step]
        at = x_row[order[tb.gathered(lo[k : k + step], n)]] * shape[1] + np.repeat(y_row[k : k + step], n)
        common += np.bincount(at, minlength=len(common))
    common = common.reshape(shape)
    total = np.bincount(x_row, minlength=shape[0])[:, None] + np.bincount(y_row, minlength=shape[1])
    return common / np.maximum(total - common, 1)


def grouped(docs: DataFrame) -> DataFrame:
    """Every row with its group: ``doc_id, cid, row, label`` (label is null for a lone class)."""
    rows = checkpointed(sketched(docs).withColumn("row", F.monotonically_increasing_id()))
    found = linked_classes(docs, rows)
    rows = rows.select("doc_id", "cid", "row")
    if found is None:
        return rows.withColumn("label", F.lit(None).cast("binary"))
    labels = checkpointed(found[1].select(F.col("node").alias("cid"), "label"))
    return rows.join(sized(labels, labels.count()), "cid", "left").select("doc_id", "cid", "row", "label")


def _firsts(rows: DataFrame) -> DataFrame:
    """Size and first row (smallest id, nulls last) of every group."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "cid")
    return rows.groupBy(F.coalesce("label", "cid").alias("group")).agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("n")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: its group's smallest id, the group's size, whether it stays."""
    rows = grouped(docs)
    firsts = _firsts(rows)
    return rows.withColumn("group", F.coalesce("label", "cid")).join(firsts, "group").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        F.col("n").alias("class_size"),
        (F.col("row") == F.col("first.row")).alias("keep"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of every group, all columns kept.

    Texts move only if more rows go than a broadcast may hold. Of rows that are equal in id and
    text one stays.
    """
    rows = grouped(docs)
    firsts = checkpointed(_firsts(rows).filter("n > 1"))
    members = rows.withColumn("group", F.coalesce("label", "cid")).join(firsts, "group")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("cid") == F.col("first.cid"))
    gone = checkpointed(members.filter(~same).select("doc_id", "cid").distinct())
    twice = checkpointed(
        members.filter(same).groupBy("doc_id", "cid").count().filter("count > 1").select("doc_id", "cid")
    )
    d, c, own_d, own_c = (free_name(docs, n) for n in ("_d", "_c", "_own_d", "_own_c"))
    keyed = docs.withColumns({own_c: text_class(), own_d: F.col("doc_id").cast("long")})
    on = F.col(own_d).eqNullSafe(F.col(d)) & (F.col(own_c) == F.col(c))

    def listed(keys: DataFrame, n: int) -> DataFrame:
        return sized(keys.select(F.col("doc_id").alias(d), F.col("cid").alias(c)), n)

    kept = keyed.join(listed(gone, gone.count()), on, "left_anti")
    n_twice = twice.count()
    if n_twice:
        single = kept.join(listed(twice, n_twice), on, "left_anti")
        repeated = kept.join(listed(twice, n_twice), on, "left_semi")
        kept = single.union(repeated.dropDuplicates([own_d, own_c]))
    return kept.select(*own_columns(docs))
