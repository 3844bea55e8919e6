import hashlib
from collections import defaultdict

import compare
import pytest
from conftest_llm import frame

from avisgrid.llm import catalog, linededup
from avisgrid.llm.common import table

BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(BLANKS).translate(LOWER)


def brute(rows, min_docs=10, keep_first=False):
    """Kept lines of every distinct (id, text), by the plain definition."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    holders, first = defaultdict(set), {}
    for doc in docs:
        for pos, line in enumerate(doc[1].split("\n")):
            holders[key_of(line)].add(doc)
            first.setdefault(key_of(line), (doc, pos))
    kept = {}
    for doc in docs:
        kept[doc] = [
            line
            for pos, line in enumerate(doc[1].split("\n"))
            if not (k := key_of(line)) or len(holders[k]) < min_docs or (keep_first and first[k] == (doc, pos))
        ]
    return kept


def check(rows, found, **how):
    kept = brute(rows, **how)
    assert len(found) == len(rows)
    for r in found:
        doc = (r["doc_id"], r["text"])
        # The order of ids with equal id goes by hash, so only unique ids know their first line.
        assert r["kept"] == "\n".join(kept[doc])
        n = doc[1].count("\n") + 1
        assert (r["n_lines"], r["n_dropped"]) == (n, n - len(kept[doc]))


ROWS = [
    *[(i, f"own {i}\nShared  line\n\nmid {i % 4}\nshared  line \n") for i in range(40)],
    *[(100 + i, "\t COMMON É line\r\nİstanbul\nend") for i in range(12)],
    *[(200 + i, "common É line") for i in range(3)],
    *[(300 + i, "common é line\n i̇stanbul") for i in range(3)],
    (400, None), (401, ""), (402, "\n"), (403, " \n \t\n"), (None, "shared  line\nonly here"),
    (405, "\n".join(["shared  line", "x"] * 20_000)), (406, "y" * 200_000 + "\nend"),
]


@pytest.mark.parametrize("parts", [1, 8, 61])
@pytest.mark.parametrize("how", [{}, {"min_docs": 1, "keep_first": True}, {"min_docs": 3}])
def test_small_documents(spark, parts, how):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = frame(spark, ROWS).repartition(5)
        check(ROWS, linededup.deduplicated(docs, **how).collect(), **how)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repeated_rows_are_one_document(spark):
    rows = [(None, "again")] * 30 + [(1, "again\nmore")] * 5
    found = linededup.deduplicated(frame(spark, rows), min_docs=3).collect()
    assert [r["n_dropped"] for r in found] == [0] * 35
    found = linededup.deduplicated(frame(spark, rows), min_docs=2).collect()
    assert sorted(r["kept"] for r in found) == [""] * 30 + ["more"] * 5


def test_a_common_key_fills_several_ranges(spark):
    rows = [(i, "everywhere\nown %d" % i) for i in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = linededup.occurrences(frame(spark, rows))
        per_part = [r["count"] for r in lines.groupBy("part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(per_part) == 1000 and max(per_part) < 300
    assert linededup.border_totals(lines).agg({"all_docs": "max"}).first()[0] == 500


def test_query_agrees_with_sql(spark, sf_dir):
    name = "op12_line_bitmaps"
    got = compare.spark_result(catalog.QUERIES[name](spark, sf_dir))
    assert compare.difference(got, compare.duckdb_result(compare.connect(sf_dir), catalog.ORACLES[name])) is None


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    found = {r["doc_id"]: r["kept_sha256"] for r in linededup.digests(docs).collect()}
    assert found == {i: hashlib.sha256("\n".join(v).encode()).hexdigest() for (i, _), v in kept.items()}


def test_odd_rows(odd, empty):
    found = linededup.digests(odd).collect()
    assert len(found) == odd.count()
    assert linededup.digests(empty).count() == 0
    assert linededup.deduplicated(odd.filter("doc_id IS NULL"), 1, True).count() == 2


def test_no_python_in_the_plan(spark, sf_dir):
    plan = linededup.digests(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
