"""Each seeded fault is found by exactly its check; the gate stops on failures."""

import pytest
from pyspark.sql import functions as F

from avisgrid import catalog
from avisgrid.plans import quality, star
from avisgrid.session import written
from avisgrid.sources import reference_data


@pytest.fixture(scope="module")
def clean(spark, sf_dir):
    seeds = reference_data.seeds(spark)
    raw = written(star.staged(catalog.raw_reviews(spark, sf_dir)), "raw")
    rows = star.numbered_reviews(star.with_keys(raw, seeds))
    return {
        "raw_reviews": raw,
        "fact_reviews": star.fact_reviews(rows),
        "fact_classifications": written(star.fact_classifications(rows), "classifications"),
        "fact_tickets": star.fact_tickets(star.numbered_tickets(rows, seeds)),
        **{n: star.dimension(seeds, n) for n in star.DIMENSIONS},
        "dim_date": star.calendar(spark),
    }


def failures(tables):
    found = quality.report(tables).where("failures > 0").collect()
    return {(r.table_name, r.check_name, r.column_name): r.failures for r in found}


def test_clean_tables_pass_all_46_checks(clean):
    report = quality.report(clean)
    assert report.count() == 46
    quality.gate(report)


FAULTS = [
    ("raw_reviews", "review_date", None, ("not_null", "review_date")),
    ("raw_reviews", "severity_code", "urgent", ("accepted_values", "severity_code")),
    ("raw_reviews", "category_source", "manuel", ("accepted_values", "category_source")),
    ("fact_reviews", "date_id", None, ("not_null", "date_id")),
    ("fact_classifications", "category_id", None, ("not_null", "category_id")),
    ("dim_severity", "code", "low", ("unique", "code")),
    ("dim_brand", "id", 1, ("unique", "id")),
]


@pytest.mark.parametrize(("table", "column", "value", "check"), FAULTS)
def test_fault(clean, table, column, value, check):
    df = clean[table]
    kind = df.schema[column].dataType
    broken = df.withColumn(
        column, F.when(F.xxhash64(*df.columns) % 2 == 0, F.lit(value).cast(kind)).otherwise(F.col(column))
    )
    if check[0] == "unique":
        broken = df.withColumn(column, F.lit(value).cast(kind))
    only = {table: broken}
    found = failures(only)
    assert list(found) == [(table, *check)]
    with pytest.raises(quality.QualityGateError, match=column):
        quality.gate(quality.report(only))


def test_repeated_id_and_nulls(clean):
    df = clean["fact_tickets"]
    repeated = df.unionByName(df.where("id <= 3"))
    assert failures({"fact_tickets": repeated}) == {("fact_tickets", "unique", "id"): 3}
    nulls = df.withColumn("id", F.lit(None).cast("bigint"))
    assert failures({"fact_tickets": nulls}) == {("fact_tickets", "not_null", "id"): df.count()}


def test_empty_tables_are_reported(clean):
    empty = {"fact_tickets": clean["fact_tickets"].where("false")}
    assert quality.report(empty).count() == 3 and failures(empty) == {}
