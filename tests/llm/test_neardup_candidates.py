"""Pairs that the similarity rule accepts meet in a bucket."""

import random

import numpy as np
import pytest
from conftest_llm import frame
from test_neardup import check

from avisgrid.llm import neardup


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_small_sets_share_a_key_for_certain():
    rng = np.random.default_rng(5)
    tried = 0
    for _ in range(3000):
        a = int(rng.integers(1, neardup.FEW + 1))
        b = int(rng.integers(a, int(a / neardup.SIMILARITY + 1e-9) + 1))
        common = int(np.ceil(neardup.SIMILARITY * (a + b) / (1 + neardup.SIMILARITY) - 1e-9))
        if common > a:
            continue
        x = rng.integers(0, 1 << 63, a + b - common, np.uint64)
        keys = [set(neardup._exact_keys(rng.permutation(s)).tolist()) for s in (x[:a], x[a - common :])]
        assert keys[0] & keys[1], (a, b, common)
        tried += 1
    assert tried > 2000


def test_short_copies(spark):
    rng = random.Random(11)
    rows = []
    for n in range(1, 31):
        for _ in range(4):
            text = words(rng, n)
            for copy in (text, text[:-1], text[1:], text + words(rng, 1), [*text[:-1], *words(rng, 1)]):
                rows.append((len(rows), " ".join(copy)))
    check(frame(spark, rows), rows)


def test_moved_and_repeated_blocks(spark):
    rng = random.Random(13)
    rows = []
    for _ in range(12):
        base = words(rng, 99)
        sentence = words(rng, rng.choice((9, 40)))
        copies = [
            base,
            base[50:] + base[:50],
            base[66:] + base[33:66] + base[:33],
            sentence * 3,
            sentence * 10,
        ]
        rows += [(len(rows) + k, " ".join(c)) for k, c in enumerate(copies)]
    check(frame(spark, rows), rows)


@pytest.mark.parametrize("n_words", [24, 60, 150])
def test_a_class_takes_few_alignments(spark, monkeypatch, n_words):
    rng = random.Random(n_words)
    base, rows = words(rng, n_words), []
    for i in range(400):
        copy = list(base)
        for _ in range(1 + rng.randrange(3)):  # all copies similar to each other
            copy[-1 - rng.randrange(max(1, n_words // 20))] = words(rng, 1)[0]
        rows.append((i, " ".join(copy)))
    taken, verified = [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, w: taken.append(pairs.count()) or verified(pairs, w))
    check(frame(spark, rows), rows)
    assert sum(taken) <= 6 * len(rows), taken
