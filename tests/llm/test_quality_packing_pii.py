import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import ODD, frame
from tokenizers import Tokenizer

import corpus_pipeline
from avisgrid.llm import decontamination, neardup, packing, pii, quality
from avisgrid.llm.common import table

# --- quality ----------------------------------------------------------------


def test_labelled_documents_are_told_apart(spark, monkeypatch):
    """Train without a fifth of the labels and test on those."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = {r["doc_id"]: r["quality"] for r in labels.collect()}
    aside = {i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    found = quality.scores(docs, labels.filter(~labels.doc_id.isin(*aside))).collect()
    assert len(found) == docs.count()
    good = [r["keep"] for r in found if rows.get(r["doc_id"]) == 1 and r["doc_id"] in aside]
    bad = [r["keep"] for r in found if rows.get(r["doc_id"]) == 0 and r["doc_id"] in aside]
    assert sum(good) >= 0.96 * len(good) and sum(bad) <= 0.25 * len(bad)
    again = quality.scores(docs, labels.filter(~labels.doc_id.isin(*aside)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found))


def test_views_teach_each_other():
    """A view with few labels of its own gets better by the other's pseudo-labels."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    views = [(y[:, None] * 2 - 1) * 0.4 + rng.normal(size=(3000, 40)).astype(np.float32) for _ in range(2)]
    known = np.where(np.arange(3000) < 90, y, -1)
    model = quality.cotrain([v.astype(np.float32) for v in views], known, np.arange(3000))
    text, page, joint = model.scores(*[v.astype(np.float32) for v in views])
    right = [((s >= 0.5) == y)[90:].mean() for s in (text, page, joint)]
    assert min(right) > 0.9 and right[2] >= max(right[:2])


def test_odd_quality(spark, odd, empty, sf_dir):
    labels = table(spark, sf_dir, "labels")
    assert quality.scores(odd, labels).count() == len(ODD)  # one class at most: all kept
    assert quality.kept(odd, labels).columns == odd.columns
    assert quality.kept(odd, labels.limit(0)).count() == len(ODD)
    assert quality.scores(empty, labels).count() == 0 and quality.kept(empty, labels).count() == 0
    some = spark.createDataFrame([(i, k % 2, None) for k, i in enumerate(range(100))], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(i, "fine words here" if i % 2 else "$$$ !!!") for i in range(100)] + ODD)
    found = {r["doc_id"]: r["keep"] for r in quality.scores(docs.drop("lang", "n_chars"), some).collect() if 20 <= (r["doc_id"] or 0) < 100}
    assert all(found[i] == bool(i % 2) for i in found)


# --- packing ----------------------------------------------------------------


def best_fit(lengths, size):
    gaps, bins = [], 0
    for x in sorted(lengths, reverse=True):
        at = min((g for g in gaps if g >= x), default=None)
        if at is None:
            bins, at = bins + 1, size
        else:
            gaps.remove(at)
        gaps.append(at - x)
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice((10, 64, 100))
    lengths = [min(size, 1 + int(rng.expovariate(3 / size))) for _ in range(rng.randint(0, 300))]
    counts = Counter(lengths)
    plan = packing.Plan(counts, size)
    used = Counter()
    for pattern, n in plan.patterns:
        assert n > 0 and sum(pattern) <= size
        for x in pattern:
            used[x] += n
    assert used == counts
    assert sum(n for _, n in plan.patterns) <= best_fit(lengths, size)


def test_exact_complements_are_found():
    plan = packing.Plan({6: 1, 2: 1, 1: 2, 5: 2, 10: 3, 7: 1, 3: 1}, 10)
    assert plan.patterns == [((10,), 3), ((7, 3), 1), ((5, 5), 1), ((6, 2, 1, 1), 1)]
    assert packing.Plan({6: 2, 3: 2, 1: 2}, 10).patterns == [((6, 3, 1), 2)]


@pytest.mark.parametrize("seed", [2, 3, 6])
def test_combinations_occur_and_never_lose(seed):
    rng = random.Random(seed)
    kinds = [rng.randint(20, 700) for _ in range(50)]
    lengths = [rng.choice(kinds) for _ in range(3000)]
    plan = packing.Plan(Counter(lengths), 1024)
    exact = Counter()
    for pattern, n in plan.patterns:
        exact[len(pattern)] += n * (sum(pattern) == 1024)
    assert exact[2] > 50 and exact[3] > 300 and exact[4] > 50  # singles, pairs, triples beside a length
    assert sum(n for _, n in plan.patterns) <= best_fit(lengths, 1024)


def packed_well(found, texts, size=1024):
    """``texts``: (id, text) of every row."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) - size * ((len(ids) - 1) // size)
        cuts = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    for _, rows in itertools.groupby(sorted(found, key=lambda r: (r["sequence_id"], r["offset"])), lambda r: r["sequence_id"]):
        at = 0
        for r in rows:
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    sequences = len({r["sequence_id"] for r in found})
    assert sequences <= best_fit([r["length"] for r in found], size)


def test_packing(spark, sf_dir, odd, empty):
    docs = table(spark, sf_dir, "documents")
    packed_well(packing.packed(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    packed_well(packing.packed(odd).collect(), [(i, t) for i, t, *_ in ODD])
    assert packing.packed(empty).count() == 0


# --- personal data ----------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def fits(kind, s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)]
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        return 12 <= len(d) <= 19 and sum(sum(divmod(v * (1 + k % 2), 10)) for k, v in enumerate(d[::-1])) % 10 == 0
    return kind == 0 or 9 <= len(d) <= 15


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if fits(k, m[0]))


def test_patterns_on_random_text():
    rng = random.Random(1)
    parts = ["@", ".", "-", " ", "+", "(", ")", "a", "é", "1", "12", "255", "4929348385146306", "b.c", "\n", "0.0.0.0", "555"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_viterbi_finds_the_best_segmentation():
    rng = np.random.default_rng(3)
    field = pii.Field()
    field.w, field.t = rng.normal(size=field.w.shape) - 0.5, rng.normal(size=field.t.shape) * 0.3
    for text in ("a@b.c 1", "+1 2-3", "1.2.3.4", "x1 (2)"):
        segments = pii.Segments(text, 0, len(text))
        spans = {(i, j): on for j in range(1, segments.n + 1) for i, on in segments.ending(j)}

        def best(at, state):
            if at == segments.n:
                return 0.0, []
            options = []
            score, rest = best(at + 1, 0)
            options.append((field.t[state, 0] + score, rest))
            for (i, j), on in spans.items():
                if i == at:
                    for kind in range(4):
                        score, rest = best(j, kind + 1)
                        own = (segments.cuts[i], kind, segments.cuts[j])
                        options.append((field.t[state, kind + 1] + field.w[on, kind].sum() + score, [own, *rest]))
            return max(options)

        assert field.decode(text, 0, len(text)) == best(0, 0)[1]


def test_training_raises_the_likelihood_of_the_truth():
    field = pii.Field()
    text = "call +1 (555) 010-4477 12345 or 190.20.30.40"
    zone = pii.zones(text)[0]
    segments = pii.Segments(text, *zone)
    gold = [(0, segments.cuts.index(text.index(" 12345")), 3)]
    for _ in range(60):
        field.update(segments, gold, 0.3)
    assert field.decode(text, *zone) == [(5, 3, text.index(" 12345"))]


def test_spans(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for i, text in texts.items():
        base, r = plain_spans(text), rows[i]
        written = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(written) <= set(r["spans"].split(","))
        if not re.search("[0-9@]", text):
            assert r["spans"] == ""


def test_dropped_matches_are_added(spark):
    clean = [(i, f"write to user{i}@mail{i}.example.org or call +1 (555) 010-{4000 + i} or 10.2.{i}.4 now") for i in range(60)]
    glued = "before +1 (555) 010-4477 190.20.30.40 after"
    docs = frame(spark, [*clean, (100, glued)])
    row = next(r for r in pii.find(docs).collect() if r["doc_id"] == 100)
    assert row["n_phone"] == 0 and row["n_ip"] == 1
    a = glued.index("+")
    assert f"phone:{a}:{a + 17}" in row["spans"].split(",")
    masked = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert masked[100]["text"] == "before <PHONE> <IP> after"
    assert masked[100]["n_chars"] == len("before <PHONE> <IP> after")
    assert masked[7]["text"] == "write to <EMAIL> or call <PHONE> or <IP> now"


def test_odd_personal_data(odd, empty):
    rows = pii.find(odd).collect()
    assert len(rows) == len(ODD)
    row = next(r for r in rows if r["doc_id"] == 12)
    assert row["n_email"] == 1 and row["n_ip"] == 1
    left = pii.redacted(odd)
    assert left.columns == odd.columns
    before = Counter(t for i, t, *_ in ODD if i != 12)
    assert Counter(r["text"] for r in left.collect() if r["doc_id"] != 12) == before
    assert pii.find(empty).count() == 0 and pii.redacted(empty).count() == 0


# --- pipeline ---------------------------------------------------------------


def test_pipeline(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    start = docs.columns
    previous = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        if k == 4:
            break
        assert docs.columns == start
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(now) == docs.count() and now.keys() <= previous.keys()
        if k < 3:
            assert all(previous[i] == t for i, t in now.items())
        else:
            assert now.keys() == previous.keys()
            assert not any(plain_spans(t) for t in now.values())
        if k == 1:
            groups = neardup.near_duplicates(docs)
            assert groups.filter("class_size > 1").count() == 0
        if k == 2:
            assert decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).count() == 0
        previous = now
    packed_well(docs.collect(), previous.items())
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    same = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in same) for r in whole) == Counter(tuple(r[c] for c in same) for r in docs.collect())


def test_pipeline_on_odd_and_no_rows(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            left = stage(spark, docs, sf_dir)
            if k < 4:
                assert left.columns == docs.columns
            assert left.count() <= docs.count() or k == 4
            if k < 4:
                docs = left


def test_training_holds_one_copy_of_its_rows():
    rng = np.random.default_rng(3)
    x = rng.random((4000, quality.TRIGRAMS)).astype(np.float16)
    y = (x[:, 0] > 0.5).astype(float)
    tracemalloc.start()
    w = quality._logistic(x, y, 1e-5, steps=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 4 * x.size
    assert np.array_equal(w, quality._logistic(x.astype(np.float32), y, 1e-5, steps=5))
    assert np.array_equal(quality._margin(x, w), quality._margin(x.astype(np.float32), w))
