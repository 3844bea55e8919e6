import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import ODD, frame
from tokenizers import Tokenizer

from avisgrid.llm import alignment
from avisgrid.llm.common import table

A, B = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(id, first byte, end) of both sides by the libraries."""
    a, b = libraries
    if not text:
        return [], []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(BYTE_OF[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    bytes_b = [
        bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in ((i, b.id_to_piece(i)) for i in ids_b)
    ]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], []
    sides = []
    for ids, found in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, side = 0, []
        for i, t in zip(ids, found):
            side.append((i, at, at + len(t)))
            at += len(t)
        sides.append(side)
    return tuple(sides)


def brute(libraries, rows):
    """Every column by comparing token ranges, ``doc_id`` first."""
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(libraries, text)
        links, j = [], 0
        for i, lo, hi in a:
            while j and b[j][1] > lo:
                j -= 1
            while j < len(b) and b[j][1] < hi:
                if b[j][2] > lo:
                    links.append((i, b[j][0]))
                j += 1
            j = max(j - 1, 0)
        counts.update(links)
        cuts = sorted({t[2] for t in a} & {t[2] for t in b})
        groups, lo = [], 0
        at_a, at_b = 0, 0
        for cut in cuts:
            sides = []
            for side, at in ((a, at_a), (b, at_b)):
                end = at
                while end < len(side) and side[end][2] <= cut:
                    end += 1
                sides.append((",".join(str(t[0]) for t in side[at:end]), end))
            groups.append(f"{sides[0][0]}|{sides[1][0]}")
            at_a, at_b = sides[0][1], sides[1][1]
        docs.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (
            doc_id, n_a, n_b, n_groups, len(links), sum(counts[k] == best[k[1]] for k in links),
            sum(counts[k] for k in links), hashlib.sha256(spelled.encode()).hexdigest() if spelled else "",
        )
        for doc_id, n_a, n_b, n_groups, links, spelled in docs
    ]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r))


@pytest.mark.parametrize("most", [0, 40, None])
def test_odd_and_random_texts(spark, libraries, most):
    rng = np.random.default_rng(5)
    alphabet = list("  aabcdeé日😀\n\t.,'1<|>▁ﬁ\x00") + ["the", " and", "<|endoftext|>", "<0x41>", "</s>", "  "]
    rows = [(100 + i, "".join(rng.choice(alphabet, int(rng.integers(0, 60))))) for i in range(150)]
    rows = [r for r in [*ODD, *rows]]
    found = alignment.alignments(frame(spark, rows).repartition(3), most=most).collect()
    assert ordered(found) == ordered(brute(libraries, rows))


def test_whole_table(spark, libraries, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = ordered(brute(libraries, rows))
    assert ordered(alignment.alignments(docs).collect()) == expected
    assert ordered(alignment.alignments(docs, most=500).collect()) == expected


def test_small_blocks_and_hand_overs(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "TOKENS", 50)
    monkeypatch.setattr(alignment, "PAIRS", 20)
    rows = [(i, "some words, déjà vu\n" * (i % 5) + "x" * i) for i in range(40)]
    assert ordered(alignment.alignments(frame(spark, rows)).collect()) == ordered(brute(libraries, rows))


def test_equal_bytes_go_by_vector(libraries):
    pair = alignment.Pair(A, B)
    a, b = libraries
    same = int((pair.same_bytes >= 0).sum())
    assert same > 10_000
    for i in np.flatnonzero(pair.same_bytes >= 0)[:2000].tolist():
        assert bytes(BYTE_OF[c] for c in a.id_to_token(i)).decode("utf-8", "replace")
        assert pair.bytes_a.joined(np.array([i])).tobytes() == pair.bytes_b.joined(pair.same_bytes[[i]]).tobytes()


def test_empty_table(empty):
    assert alignment.alignments(empty).count() == 0


def test_head_never_holds_more(spark):
    counts = spark.createDataFrame([(i, False, 1 + i % 50) for i in range(1000)] + [(5000, True, 9)], "pair long, same boolean, n long")
    for most in (0, 19, 20, 500, 999):
        frequent, whole = alignment.head(counts, most)
        assert frequent.count() <= most and not whole
    assert alignment.head(counts, 1000)[0].count() == 1000 and alignment.head(counts, 1000)[1]
