import hashlib
import zlib

import pytest
import xxhash
from conftest_llm import ODD, frame

from avisgrid.llm import sharding, winnowing
from avisgrid.llm.common import table


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 997])
def test_permutation_is_whole(spark, n):
    place = sharding.permuted(sharding.F.col("row"), n, walks=sharding.longest_walk(spark, n))
    rows = spark.range(n).toDF("row").withColumn("p", place).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    for r in rows:
        assert sharding.locate(r["row"], n, 5) == (r["p"] % 5, r["p"] // 5)


def test_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = sharding.shards(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    order = sorted(texts)
    for r in rows:
        assert order[r["row"]] == r["doc_id"]
        assert (r["shard"], r["slot"]) == sharding.locate(r["row"], len(rows))
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "rows")
        assert r["grown_shard"] is None
    counts = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_odd_rows_are_sharded(odd, empty):
    rows = sharding.shards(odd).collect()
    assert len(rows) == len(ODD)
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(ODD)
    assert [r["size"] for r in rows if r["doc_id"] == 3] == [1]
    assert sharding.shards(empty).count() == 0


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def h64(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def brute(text):
    """Kept (hash, position) pairs by the plain definition."""
    tokens = [w[i : i + 20] for w in text.lower().split() for i in range(0, len(w), 20)]
    h = [h64(t.encode()) for t in tokens]
    for step in (1, 2):
        h = [h64(h[i], h[i + step]) if i + step < len(h) else h64(h[i]) for i in range(len(h))]
    grams = [x & ((1 << 33) - 1) for x in h[: max(len(h) - 3, min(len(h), 1))]]
    kept = []
    for i in range(max(len(grams) - 7, min(len(grams), 1))):
        window = [(g, -p) for p, g in enumerate(grams[i : i + 8], i)]
        g, p = min(window)
        if (g, -p) not in kept:
            kept.append((g, -p))
    return kept


def test_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r for r in winnowing.fingerprints(docs).collect()}
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r, after = rows[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        kept = brute(text)
        assert r["fingerprint"] == ",".join(f"{g:x}:{p}" for g, p in kept)
        a, b, c = ({g for g, _ in brute(t)} for t in (text, edited, after))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
        assert r["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1)


def test_shared_runs_share_a_hash():
    run = [f"shared{i}" for i in range(11)]
    for k in range(20):
        a = brute(" ".join([f"a{i}" for i in range(k)] + run + ["x"] * (k % 7)))
        b = brute(" ".join(run + [f"b{i}" for i in range(k)]))
        assert {g for g, _ in a} & {g for g, _ in b}


def test_order_around_bucket_borders(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "BUCKET_ROWS", 7)
    rows = [(i * i * 1_000_003, f"text {i}") for i in range(100)] + [(None, None), (4 * 1_000_003, "tie")]
    docs = frame(spark, rows).select("doc_id", "text")
    docs = docs.withColumn("text", winnowing.F.coalesce("text", winnowing.F.lit("")))
    found = winnowing.with_next(docs.repartition(5), "doc_id", {"after": "text"}).collect()
    order = sorted(((-1, i) if i is None else (0, i), t or "") for i, t in rows)
    order = [t for _, t in order]
    assert sorted((r["text"], r["after"]) for r in found) == sorted(zip(order, order[1:] + order[:1]))


def test_odd_rows_have_fingerprints(odd, empty):
    rows = winnowing.fingerprints(odd).collect()
    assert len(rows) == len(ODD)
    by_text = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by_text[3] == by_text[4] == by_text[5] == {""}
    assert by_text[7] == by_text[8]
    assert winnowing.fingerprints(empty).count() == 0
    lone = winnowing.fingerprints(frame(odd.sparkSession, [(1, "just one text")])).collect()
    assert lone[0]["near_next"] == 1.0
