"""Ranking operators against plain Python, with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from avisgrid.operators import ranking
from avisgrid.operators.ranking import cap_groups, dense_id, first_per_key, renumber


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows():
    """6,000 rows; one key holds a third of them, some keys are NULL."""
    rng = random.Random(3)
    return [
        (
            i,
            "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rng.randint(0, 900)}"),
            rng.randint(0, 1000),
        )
        for i in range(6000)
    ]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "i long, k string, v int").repartition(13, "i")


def test_first_per_key(table, rows):
    got = first_per_key(table, ["k"], [F.col("v").desc(), F.col("i").asc()])
    text = plan(got)
    best = {}
    for i, k, v in rows:
        if k not in best or (-v, i) < (-best[k][2], best[k][0]):
            best[k] = (i, k, v)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(best.values(), key=repr)
    # One row per key and map task crosses the shuffle, hot or not.
    assert text.count("WindowGroupLimit") == 2
    limits = text[text.index("WindowGroupLimit") :]
    assert limits.index("Final") < limits.index("Exchange") < limits.index("Partial")


@pytest.mark.parametrize("n,stretch,bins", [(1, 5, 3), (7, 1, 2), (100, 50, 1024), (1999, 10, 16), (5000, 9, 4)])
def test_cap_groups(table, rows, monkeypatch, n, stretch, bins):
    monkeypatch.setattr(ranking, "BINS", bins)
    got = cap_groups(table, ["k"], [F.col("v").asc(), F.col("i").asc()], n, F.col("v"), stretch)
    expected = []
    for key in {k for _, k, _ in rows}:
        group = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        expected += group[:n]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_cap_off(table):
    assert cap_groups(table, ["k"], [F.col("i").asc()], 0, F.col("i")) is table


def test_only_the_stretch_of_the_nth_row_is_ranked(table, rows):
    places = table.withColumn("_at", F.col("v").cast("bigint")).select("k", "_at")
    cuts = {r["_k"]: r for r in ranking._cuts(places, ["k"], 1000, 20).collect()}
    hot = cuts["hot"]
    assert hot.inside <= 20 and hot.before < 1000 <= hot.before + hot.inside
    assert hot.before == sum(k == "hot" and v < hot.lo for _, k, v in rows)
    extremes = places.sparkSession.createDataFrame([("a", -(1 << 63)), ("a", (1 << 63) - 1), ("a", 0)] * 9, "k string, _at bigint")
    assert ranking._cuts(extremes, ["k"], 10, 4).first().before == 9


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_dense_id_ignores_partitioning(table, rows, parts):
    order = [F.col("v").desc(), F.col("i").asc()]
    got = dense_id(table.repartition(parts), order)
    expected = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert [(r.id, r.i) for r in got.orderBy("id").collect()] == [
        (n + 1, r[0]) for n, r in enumerate(expected)
    ]


def test_dense_id_uses_many_tasks(spark, table):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = dense_id(table, [F.col("v").desc(), F.col("i").asc()])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got.inputFiles()) > 4
    # Only the offsets, one row per partition, are gathered.
    single = [p for p in plan(got).split("\n") if "SinglePartition" in p]
    assert len(single) == 1


def test_dense_id_of_nothing(table):
    assert dense_id(table.where("i < 0"), [F.col("i").asc()]).count() == 0


@pytest.mark.parametrize("block", [10, 64, 100, 1 << 20])
def test_renumber(spark, block):
    kept = [i for i in range(1, 3000) if i % 7 in (0, 3) or 500 < i < 700]
    df = spark.createDataFrame([(i, f"x{i}") for i in kept], "id long, x string").repartition(9)
    got = renumber(df, "id", "n", block).orderBy("n").collect()
    assert [(r.n, r.id) for r in got] == [(n + 1, i) for n, i in enumerate(kept)]
