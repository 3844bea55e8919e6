"""The bucketed ledger of pushed tickets."""

import re

from avisgrid.plans import activation, ledger


def keys(df):
    return sorted(r[0] for r in df.collect())


def test_days_and_repeated_days(spark, tmp_path):
    path = str(tmp_path / "ledger")

    def frame(*k):
        return spark.createDataFrame([(x,) for x in k], "review_key string")

    assert keys(ledger.pushed_by_others(spark, path, "d1")) == []
    ledger.record(spark, path, frame("a", "b", "b", None), "d1", buckets=3)
    assert keys(ledger.pushed_by_others(spark, path, "d1")) == []
    assert keys(ledger.pushed_by_others(spark, path, "d2")) == ["a", "b"]
    ledger.record(spark, path, frame("c"), "d2")
    ledger.record(spark, path, frame("d"), "d2")
    assert sorted(map(tuple, ledger.read(spark, path).collect())) == [("a", "d1"), ("b", "d1"), ("d", "d2")]


def test_the_ledger_does_not_move(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.record(spark, path, spark.range(200).selectExpr("CAST(id AS STRING) AS review_key"), "d1", buckets=5)
    tickets = spark.range(100, 300).selectExpr("CAST(id AS STRING) AS review_key", "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = activation.new_tickets(tickets, ledger.pushed_by_others(spark, path, "d2"))
        after = ledger.merged(ledger.read(spark, path), fresh, "d2")
        for df in (fresh, after):
            stack, scans = [], 0
            for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
                at = len(line) - len(line.lstrip(" :+-"))
                stack = [(d, n) for d, n in stack if d < at] + [(at, line.strip(" :+-"))]
                if re.search(r"FileScan .*bucketed_", line):
                    scans += 1
                    assert not any(n.startswith("Exchange") for _, n in stack)
            assert scans >= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert fresh.count() == 100 and after.count() == 300
