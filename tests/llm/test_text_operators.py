import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import ODD, frame
from tokenizers import Tokenizer

from avisgrid.llm import decontamination, language, maxent, transducer
from avisgrid.llm import textblocks as tb
from avisgrid.llm.bytepairs import PieceIds
from avisgrid.llm.common import checkpointed, table

PARTS = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "²", "٣", "中", "!", "<|endoftext|>",
         "<|startoftext|>", "<|", " ", " ", "​", "😀", "é", "\r\n", "\x85", "İ", "Σ", "\x1c", "'S", "ing"]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(8)) for _ in range(n)]
    return texts + ["ha" * 2000, "'" * 300, "".join(rng.choice("abcdefgh") for _ in range(3000))]


def joined(texts):
    raws = [t.encode() for t in texts]
    return b"".join(raws), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)


# --- language ---------------------------------------------------------------


def test_held_out_languages(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.languages(docs).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_bundles_follow_the_definition():
    encoder = language.Encoder(64)
    texts = ["Ab, cd", "", "..", "é"]
    found = encoder.bundles(*joined(texts))
    for text, row in zip(texts, found):
        words = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        total = np.zeros(64)
        if words.strip():
            for a, b, c in zip(words, words[1:], words[2:]):
                v = [encoder._letter(0 if x == " " else ord(x)) for x in (a, b, c)]
                total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        assert (row == total).all()


def test_odd_languages(spark, odd, empty):
    rows = language.languages(odd).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows} == {"und"}  # nothing to learn from
    assert language.languages(empty).count() == 0
    some = frame(spark, [(i, "the cat and the hat", "en") for i in range(20)] + [(99, None, "en"), (98, "123 !", None), (97, "hat", None)])
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(some).collect()}
    assert found[99] == found[98] == ("und", 0.0) and found[97][0] == "en" and found[0][1] > 0.9


def test_many_letters_are_bundled_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 650))) for _ in range(512)]
    raws = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    encoder = language.Encoder()
    tracemalloc.start()
    whole = encoder.bundles(b"".join(raws), offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    alone = encoder.bundles(raws[7], np.array([0, len(raws[7])]))
    assert (whole[7] == alone[0]).all() and np.abs(alone).max() > 10


def test_table_and_text_order_agree(monkeypatch):
    raw = "the quick brown fox, été à la plage — the end".encode()
    encoder, offsets = language.Encoder(), np.array([0, 20, len(raw)])
    table_ = encoder.bundles(raw, offsets)
    monkeypatch.setattr(language, "DISTINCT", 0)
    monkeypatch.setattr(language, "AT_ONCE", 7)
    assert (encoder.bundles(raw, offsets) == table_).all()


# --- decontamination --------------------------------------------------------


def test_search_finds_all_items():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(70)]
    index = decontamination.Index(items)
    terms = index.terms.tolist()
    for _ in range(200):
        chosen = sorted(rng.sample(range(len(terms)), rng.randint(1, len(terms))))
        scores = [
            sum(index.impacts[t][index.items[t].index(i)] for t in chosen if i in index.items[t])
            for i in range(len(items))
        ]
        for threshold in (0.3, 0.5, 0.9):
            found = dict(index.search(chosen, threshold))
            assert found == pytest.approx({i: s for i, s in enumerate(scores) if s >= threshold - 1e-9})


def test_whole_items_are_leaks(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    texts = [(r["doc_id"], plain(r["text"])) for r in docs.collect()]
    whole = {(d, r["item_id"]) for r in items.collect() for d, t in texts if plain(r["text"]) in t}
    rows = decontamination.leaks(docs, items).collect()
    assert whole and {(r["doc_id"], r["item_id"]) for r in rows} == whole
    left = decontamination.clean(docs, items)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in texts} - {d for d, _ in whole}


def test_questions_without_answers_stay(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"q{rng.randrange(10**6)}" for _ in range(40)]
    items = spark.createDataFrame(
        [(1, " ".join(words)), (2, None), (3, "  "), (None, "short one"), (1, " ".join(words))], "item_id long, text string"
    )
    filler = [f"f{rng.randrange(10**6)}" for _ in range(500)]
    docs = frame(
        spark,
        [
            (1, " ".join(filler + words + filler)),
            (2, " ".join(filler + words[:30] + filler)),  # the question alone
            (3, " ".join(words[30:])),  # the answer alone
            (4, " ".join(filler + words[:20] + ["typo"] + words[21:] + filler).upper()),
            (5, "a SHORT, one."),
            *ODD,
        ],
    )
    for size in (decontamination.ITEMS, 2):  # one index block, and several
        monkeypatch.setattr(decontamination, "ITEMS", size)
        rows = [(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()]
        assert sorted(rows, key=str) == sorted([(1, 1), (1, 1), (4, 1), (4, 1), (5, None)], key=str)
        assert decontamination.clean(docs, items).count() == docs.count() - 3
    assert decontamination.leaks(docs, items.limit(0)).count() == 0
    assert decontamination.clean(docs, items.limit(0)).count() == docs.count()


def test_scores_do_not_depend_on_the_index_blocks(spark, sf_dir, monkeypatch):
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = []
    for size in (20_000, 20, 6):
        monkeypatch.setattr(decontamination, "ITEMS", size)
        found.append(sorted(tuple(r) for r in decontamination.leaks(docs, items).collect()))
    assert found[0] and found[0] == found[1] == found[2]


def test_no_documents(spark, empty, sf_dir):
    assert decontamination.leaks(empty, table(spark, sf_dir, "benchmark")).count() == 0


# --- tokens -----------------------------------------------------------------


def test_transducer_counts(spark, sf_dir, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = fuzz(1500) + [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    expected = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    counter = transducer.Counter(path)
    assert counter.counts(*joined(texts)).tolist() == expected
    monkeypatch.setattr(transducer, "CHUNK", 3)  # most chunks lie inside one word
    monkeypatch.setattr(transducer, "STATES", 100)  # states are dropped between blocks
    for k in range(0, len(texts), 500):
        assert counter.counts(*joined(texts[k : k + 500])).tolist() == expected[k : k + 500]


def test_token_counts(odd, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = transducer.token_counts(odd).collect()
    expected = [
        (i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048)
        for i, t, *_ in ODD
    ]
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert transducer.token_counts(empty).count() == 0


def test_piece_ids(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), PieceIds(path)
    texts = fuzz(1500, 2) + [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    ids, at = encoder.encode(*joined(texts))
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == expected


def test_blocks_are_bounded():
    import pyarrow as pa

    texts = ["aa", None, "b" * 50, "", "ccc", "dd"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(1)
    parts = list(tb.blocks(batch, "text", 5))
    assert [(a, b) for a, b, _, _ in parts] == [(0, 1), (1, 2), (2, 5)]
    assert [raw[s:e].decode() for _, _, raw, o in parts for s, e in zip(o, o[1:])] == [t or "" for t in texts[1:]]


# --- language model ---------------------------------------------------------


def base_scores(rows):
    tokens = {}
    for k, (i, text, *_) in enumerate(rows):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        tokens[k] = (i, re.findall(r"[^\x20\x09-\x0D]+", low) + [None])
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, _) in tokens.items()}
    c = Counter(w for k, (_, ws) in tokens.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return [
        (i, held[k], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        for k, (i, ws) in tokens.items()
    ]


def same_base(found, rows):
    got = sorted([tuple(r)[:6] for r in found], key=lambda r: (str(r[0]), r[2]))
    expected = sorted(base_scores(rows), key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in expected])


def test_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = maxent.scores(docs, size=20_000).collect()  # several batches
    same_base(found, [(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in found)


def test_odd_scores(odd, empty):
    same_base(maxent.scores(odd).collect(), ODD)
    assert maxent.scores(empty).count() == 0


def test_only_held_out_documents(spark):
    i = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = maxent.scores(frame(spark, [(i, "no training text")])).collect()[0]
    assert (row["held_out"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (True, 0, 0, 0.0, 0.0)


def test_class_probabilities_sum_to_one():
    logs = maxent._log_softmax(np.random.default_rng(0).normal(size=(5, 7)))
    assert np.exp(logs).sum(1) == pytest.approx(np.ones(5))
    features = maxent._features(np.arange(maxent.CONTEXTS))
    assert features.min() >= 0 and features.max() < maxent.FEATURES


def test_words_before_not_only_their_endings(spark):
    """Words of one class as contexts: which of them came before decides what follows."""
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1]
    texts = ["station opens today", "nation closes early"]  # two before as well
    rows = [(i, texts[k % 2]) for k, i in enumerate(train[:600])]
    asked = ["station opens", "nation opens", "x station opens today", "x nation opens today"]
    rows += list(zip(held, asked))
    found = {r["doc_id"]: r for r in maxent.scores(frame(spark, rows), size=200).collect()}
    right, wrong, skip, not_skip = (found[i] for i in held[:4])
    assert right["base_score"] == wrong["base_score"]
    assert right["score"] > wrong["score"] + 0.5
    assert skip["score"] > not_skip["score"] + 0.5


def test_scores_against_a_plain_version(spark, monkeypatch):
    """Every column for given weights, word by word."""
    weights = np.random.default_rng(5).normal(size=(maxent.FEWEST, maxent.CLASSES)).astype(np.float32)
    monkeypatch.setattr(maxent, "trained", lambda *_: weights)
    rng, words = random.Random(3), ["a", "ab", "cab", "dog", "log", "é", "new", "Ab"]
    rows = [(i, " ".join(rng.choice(words[: 6 + i % 3]) for _ in range(i % 7))) for i in range(90)]
    found = maxent.scores(frame(spark, rows), size=100).collect()
    same_base(found, rows)
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", text.lower()), None] for i, text in rows}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)

    def code(word):
        return 0 if word is None else int(maxent._tokens(*joined([word]))[0][0])

    mass = np.zeros(maxent.CLASSES)
    for w, c in count.items():
        mass[code(w) % maxent.CLASSES] += c + 0.5
    whole = sum(count.values()) + 0.5 * (len(count) + 1)
    expected = {}
    for i, ws in tokens.items():
        total, codes = 0.0, [code(w) for w in ws]
        for k, w in enumerate(ws):
            one, two = (codes[k - j] if k >= j else 0 for j in (1, 2))
            at = maxent._features(np.array([one], np.uint64), two, maxent.FEWEST)[0]
            odds = np.where(mass > 0, mass * np.exp(weights[at].sum(0, dtype=float)), 0)
            kind = codes[k] % maxent.CLASSES
            known = odds[kind] / odds.sum() * (count[w] + 0.5) / mass[kind] * (1 - 0.5 / whole) if count[w] else 0.5 / whole
            total += math.log10(known)
        expected[i] = total
    assert {r["doc_id"]: r["score"] for r in found} == pytest.approx(expected, rel=1e-4)


def test_table_grows_with_distinct_word_pairs():
    one = np.arange(1 << 12, dtype=np.uint64) << np.uint64(6)  # one class
    small, large = (maxent._features(one, 7, rows) for rows in (maxent.FEWEST, maxent.FEATURES))
    assert len(np.unique(small[:, 0])) < len(np.unique(large[:, 0]))
    assert len(np.unique(large[:, 0])) > 3500 and len(np.unique(large[:, 3])) == 1


def test_one_gradient_of_the_tables_size_reaches_the_driver(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 50}" for j in range(1, 40))) for i in range(300)]
    stored = checkpointed(maxent.batches(frame(spark, rows).repartition(6), size=1000))
    assert stored.count() == 6
    weights = np.random.default_rng(2).normal(size=(2 * maxent.SUMMED, maxent.CLASSES)).astype(np.float32)
    prior = np.full(maxent.CLASSES, -np.log(maxent.CLASSES), np.float32)
    texts = stored.select("batch", "held_out", "n_tokens", "word", "hash")
    whole = np.zeros_like(weights)
    left = texts.toArrow()
    for row in range(left.num_rows):
        held = np.array(left.column("held_out")[row].as_py())
        maxent._errors(whole, weights, prior, maxent._words(left, row), held)
    collect, sizes = type(texts).collect, []

    def counted(df):
        found = collect(df)
        sizes.append(sum(len(r["g"]) for r in found))
        return found

    monkeypatch.setattr(type(texts), "collect", counted)
    found = maxent._gradient(texts, weights, prior)
    assert sizes == [weights.nbytes]
    assert np.allclose(found, whole, atol=1e-3) and np.abs(whole).max() > 1
    assert not maxent._gradient(texts.filter("false"), weights, prior).any()


def plain_training(texts, rows, prior, steps):
    """Weights after some steps, each over all texts, token by token."""
    contexts = []
    for text in texts:
        codes = maxent._tokens(*joined([text]))[0].tolist()
        for k, code in enumerate(codes):
            one, two = (codes[k - j] if k >= j else 0 for j in (1, 2))
            contexts.append((maxent._features(np.array([one], np.uint64), np.uint64(two), rows)[0], code % maxent.CLASSES))
    weights = np.zeros((rows, maxent.CLASSES))
    squares = np.full_like(weights, maxent.DAMPING)
    for _ in range(steps):
        g = np.zeros_like(weights)
        for at, kind in contexts:
            odds = np.exp(weights[at].sum(0) + prior)
            for row in at:
                g[row] -= odds / odds.sum()
                g[row, kind] += 1
        squares += g * g
        weights += maxent.RATE * g / np.sqrt(squares)
    return weights


def test_every_step_takes_every_training_text(spark):
    """However many batches there are, in tables of few rows and with texts that are held out, empty or repeated."""
    rng, words = random.Random(8), [f"w{k}" for k in range(40)] + ["é", "a", "The"]
    rows = [(i, " ".join(rng.choice(words[: 4 + i % 40]) for _ in range(i % 17))) for i in range(150)]
    rows += rows[:20] + [(None, "a null id w1"), (200, None)]
    train = [text or "" for i, text in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    prior = np.log(np.random.default_rng(4).dirichlet(np.ones(maxent.CLASSES))).astype(np.float32)
    expected = plain_training(train, maxent.FEWEST, prior, 4)
    assert np.abs(expected).max() > 0.5
    for n in (1, 40):
        stored = checkpointed(maxent.batches(frame(spark, rows).repartition(n), size=50))
        assert stored.count() == n
        assert np.allclose(maxent.trained(stored, maxent.FEWEST, prior, 4), expected, atol=1e-4)


def test_gradients_of_many_contexts_in_few_rows():
    """More contexts than are held at once, rows of many contexts and of one, classes that never occur."""
    rng = np.random.default_rng(6)
    known = np.concatenate([np.zeros(1, np.uint64), rng.integers(1, 1 << 63, 3000).astype(np.uint64)])
    n = rng.integers(1, 60, 900)
    word = np.minimum(rng.pareto(0.3, n.sum()).astype(np.int64), 2999) + 1
    held = rng.random(len(n)) < 0.2
    weights = rng.normal(size=(maxent.FEWEST, maxent.CLASSES)).astype(np.float32)
    prior = np.log(rng.dirichlet(np.ones(maxent.CLASSES))).astype(np.float32)
    prior[[5, 9]] = -np.inf
    one, two = maxent._contexts(word, n)
    assert len(np.unique(one * len(known) + two)) > maxent.AT_ONCE
    rows = maxent._features(known[one], known[two], len(weights))[~np.repeat(held, n)]
    kind = (known[word] % np.uint64(maxent.CLASSES)).astype(int)[~np.repeat(held, n)]
    error = -np.exp(maxent._class_logs(weights.astype(float), rows, prior))
    error[np.arange(len(kind)), kind] += 1
    expected = np.zeros(weights.shape)
    for k in range(rows.shape[1]):
        np.add.at(expected, rows[:, k], error)
    found = np.zeros_like(weights)
    maxent._errors(found, weights, prior, (n, word, known), held)
    assert np.allclose(found, expected, atol=2e-2, rtol=1e-4) and np.abs(expected).max() > 100
    none = np.zeros_like(weights)
    maxent._errors(none, weights, prior, (n, word, known), np.ones(len(n), bool))
    assert not none.any()
