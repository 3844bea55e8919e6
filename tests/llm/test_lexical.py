import math
import re
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest
from conftest_llm import ODD, frame
from pyspark.sql import types as T

from avisgrid.llm import catalog, lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = T.StructType([T.StructField(c, t) for c, t in (
    ("item_id", T.LongType()), ("text", T.StringType()), ("score", T.StringType()), ("rank", T.StringType()))])


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document scored for every item by the plain formula."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    result = defaultdict(list)
    for item, text in set(items):
        scores = []
        for i, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms_of(text)) if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i))
        result[item] += [(r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return {i: sorted(v) for i, v in result.items() if v}


def found_by(spark, docs, items, k=10):
    item_frame = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)
    rows = defaultdict(list)
    for r in lexical.ranked(frame(spark, docs).repartition(4), item_frame, k).collect():
        rows[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return {i: sorted(v) for i, v in rows.items()}


def corpus(n=400, seed=7):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éa", "日本", "W1"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda m: " ".join(rng.choice(words, m, p=p / p.sum()))
    docs = [(i * 7 % 1009, text(int(rng.integers(0, 90)))) for i in range(n)]
    docs += [(2000 + i, docs[5][1]) for i in range(30)]  # ties
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("shard,short,window", [(16_384, 4096, 2048), (37, 40, 8), (5, 0, 1), (64, 10_000, 4)])
def test_ranks_agree_with_all_scores(spark, monkeypatch, shard, short, window):
    for name, value in (("SHARD_DOCS", shard), ("SHORT", short), ("WINDOW", window)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    for k in (1, 10):
        found = found_by(spark, docs, items, k)
        assert found == brute(docs, items, k)


def test_results_do_not_depend_on_blocks_or_vocabulary(spark, monkeypatch):
    docs, items = corpus(120)
    whole = found_by(spark, docs, items)
    monkeypatch.setattr(lexical, "ITEMS", 4)
    monkeypatch.setattr(lexical, "VOCABULARY", 3)
    assert found_by(spark, docs, items) == whole == brute(docs, items)


def test_top_skips_and_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        lists = []
        for _ in range(int(rng.integers(1, 9))):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.3, 0.9])).astype(np.int32)
            if len(docs):
                lists.append((docs, rng.integers(1, 6 if rng.random() < 0.5 else 10**6, len(docs))))
        dense = np.zeros(n, np.int64)
        for docs, scores in lists:
            dense[docs] += scores
        for floor in (1, 5):
            order = [i for i in np.lexsort((np.arange(n), -dense)) if dense[i] >= floor][:10]
            if lists:
                docs, scores = lexical.top(lists, 10, floor)
                assert docs.tolist() == order and scores.tolist() == dense[order].tolist()


def test_odd_documents_and_items(spark):
    items = [(1, "same words WORD text"), (1, "low"), (2, None), (3, ""), (None, "null x"), (4, "mail"), (4, "mail"), (5, "!!!")]
    assert found_by(spark, ODD, items) == brute(ODD, items)
    assert found_by(spark, [], items) == {} and found_by(spark, ODD, []) == {}


def test_query_agrees_with_sql(spark, sf_dir):
    name = "op13_hybrid_taat_daat"
    got = compare.spark_result(catalog.QUERIES[name](spark, sf_dir))
    assert compare.difference(got, compare.duckdb_result(compare.connect(sf_dir), catalog.ORACLES[name])) is None
