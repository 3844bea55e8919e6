"""One edited word of an item does not hide its leak."""

import random

import numpy as np
import pytest

from avisgrid.llm import decontamination
from avisgrid.llm import textblocks as tb


def leaked(index, text):
    raw = text.encode()
    hashes, *_ = tb.word_hashes(tb.Folder(str.isalnum), raw, np.array([0, len(raw)]))
    return [index.ids[i] for i, *_ in index.leaks(index.lookup(hashes), hashes)]


@pytest.mark.parametrize("n", [*range(15, 25), 32, 38, 39, 40, 47, 59])
def test_one_edit_at_every_position(n):
    rng = random.Random(n)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    item, filler = words(n), words(150)
    index = decontamination.Index([(1, " ".join(item)), *((k, " ".join(words(30))) for k in range(2, 30))])
    for p in range(n):
        for put in (["edited"], [], [item[p], "more"]):
            copy = item[:p] + put + item[p + 1 :]
            assert leaked(index, " ".join(filler + copy + filler)) == [1], (p, put)
    question = item[: n - n // 4]
    assert leaked(index, " ".join(filler + question + filler)) == []
    assert leaked(index, " ".join(filler + question + [item[-1]] + filler)) == []
