import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, frame

from avisgrid.llm import neardup
from avisgrid.llm.common import table
from avisgrid.llm.components import components


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    """Smallest id of every row's component, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders, common = {}, Counter()
    for i, s in sets.items():
        for x in s:
            for other in holders.setdefault(x, []):
                common[other, i] += 1
            holders[x].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = [(a, b) for (a, b), c in common.items() if c / (len(sets[a]) + len(sets[b]) - c) >= 0.8]
    texts = {}
    for i, t in rows:
        pairs.append((texts.setdefault(t or "", i), i))
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def check(docs, rows):
    found = neardup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == groups(rows)
    sizes = Counter(r["class_id"] for r in found)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in found)
    assert Counter(r["class_id"] for r in found if r["keep"]) == Counter(set(sizes))
    return found


def test_against_all_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def near_group(n, seed=7):
    """Copies of one text with few to many edits: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(7)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice(([], [f"e{rng.randrange(10**6)}"], [words[k], "more"]))
        rows.append((i, " ".join(words)))
    return rows + [(n + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(60))) for i in range(20)]


@pytest.mark.parametrize("crowd", [1, 10_000])
def test_group_around_the_threshold(spark, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = near_group(120)
    check(frame(spark, rows), rows)


def test_block_overlap_is_exact():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint64) for _ in range(12)]
    sides = []
    for part in (texts[:5], texts[5:]):
        row = np.repeat(np.arange(len(part)), [len(w) for w in part])
        run, row = neardup._shingles(np.concatenate(part), row, len(part))
        sides.append((neardup._labelled(run, row), row))
    found = neardup._overlap(*sides, (5, 7))
    for i in range(5):
        for j in range(7):
            a, b = (set(s[0][s[1] == k].tolist()) for s, k in zip(sides, (i, j)))
            assert found[i, j] == pytest.approx(len(a & b) / len(a | b))


def test_alignment_follows_order():
    a = np.arange(1, 101, dtype=np.uint64)
    assert neardup.aligned(a, a) == 1.0
    assert neardup.aligned(a, np.delete(a, 50)) == pytest.approx((96 - 5) / (96 + 95 - 91))
    assert neardup.aligned(a, a + np.uint64(1000)) == 0.0
    assert neardup.aligned(a[:0], a[:0]) == 1.0 and neardup.aligned(a[:0], a) == 0.0
    moved = np.concatenate([a[50:], a[:50]])
    assert neardup.aligned(a, moved) == pytest.approx(92 / 100)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, i) for i in range(501, 560)]
    links += [(1000 + i, 1001 + i) for i in range(40)]
    found = components(spark.createDataFrame([(str(a).zfill(4), str(b).zfill(4)) for a, b in links], "a string, b string"))
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {i for a, b in links if a != b for i in (a, b)}
    expected = {(str(i).zfill(4), str(find(i)).zfill(4)) for i in linked}
    rows = [(r["node"], r["label"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_odd_rows(odd, empty):
    found = neardup.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    keep = Counter(r["doc_id"] for r in found if r["keep"])
    assert keep[7] == 1 and keep[8] == 0 and keep[9] == keep[10] == keep[12] == 1
    assert sum(r["keep"] for r in found if r["doc_id"] in (3, 4, None)) == 2  # one empty text, one with a null id
    assert neardup.near_duplicates(empty).count() == 0


def test_one_document_of_each_group_stays(spark, odd, empty):
    left = neardup.deduplicated(odd)
    assert left.columns == odd.columns
    rows = left.collect()
    assert Counter(r["doc_id"] for r in rows)[7] == 1
    assert len(rows) == sum(r["keep"] for r in neardup.near_duplicates(odd).collect())
    assert neardup.deduplicated(empty).count() == 0
    rows = near_group(60)
    docs = frame(spark, rows)
    assert {r["doc_id"] for r in neardup.deduplicated(docs).collect()} == set(groups(rows).values())


def test_stars_take_no_rounds(spark, monkeypatch):
    rounds, step = [], neardup.components.__globals__["_large_star"]
    monkeypatch.setitem(neardup.components.__globals__, "_large_star", lambda *a: rounds.append(1) or step(*a))
    stars = [(1, 2), (3, 1), (1, 1), (1, 4), (5, 6)]
    found = components(spark.createDataFrame(stars, "a int, b int"))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)}
    assert not rounds
    found = components(spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "a int, b int"))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (9, 1)}
    assert len(rounds) == 1


def test_crowds_are_compared_only_where_there_are_some(spark, monkeypatch):
    called, links = [], neardup._crowd_links
    monkeypatch.setattr(neardup, "_crowd_links", lambda *a: called.append(1) or links(*a))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " end"), (3, "another text of its own with enough words in it")]
    check(frame(spark, rows), rows)
    assert not called


def test_short_tables_of_pairs_take_few_tasks(spark, monkeypatch):
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    taken, verified = [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, w: taken.append(pairs.rdd.getNumPartitions()) or verified(pairs, w))
    rows = [(i, " ".join(f"w{i % 30}x{j}" for j in range(40)) + f" end{i // 30}") for i in range(60)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        check(frame(spark, rows), rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert taken and max(taken) <= neardup.PARTITIONS
