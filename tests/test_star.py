"""Facts and marts: invariants and cases the fixture does not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from avisgrid import catalog, schemas
from avisgrid.plans import activation, marts, star
from avisgrid.sources import reference_data

RAW_DEFAULTS = {
    "source_code": "app_store",
    "brand_code": "abritel",
    "review_date": dt.datetime(2024, 1, 10, 12),
    "rating": 3,
    "text": "Un avis assez long",
    "collected_at": dt.datetime(2024, 2, 1),
    "is_exploitable": True,
    "category_code": "service_client",
    "category_source": "heuristic",
    "persona_code": "locataire",
    "severity_code": "low",
    "classified_at": dt.datetime(2024, 2, 1),
}


def raw(spark, *rows):
    """Raw reviews from the columns that matter to a case."""
    full = [
        tuple({**RAW_DEFAULTS, "source_review_id": str(i), **row}.get(c) for c in schemas.RAW.fieldNames())
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.RAW)


@pytest.fixture(scope="module")
def seeds(spark):
    return reference_data.seeds(spark)


def test_newest_copy_wins_and_a_null_time_counts_as_newest(spark):
    got = star.staged(
        raw(
            spark,
            {"source_review_id": "a", "collected_at": dt.datetime(2024, 1, 1), "rating": 1},
            {"source_review_id": "a", "collected_at": dt.datetime(2024, 1, 2), "rating": 2},
            {"source_review_id": "b", "rating": 4},
            {"source_review_id": "b", "collected_at": None, "rating": 5},
            {"source_review_id": "a", "source_code": "trustpilot", "rating": 3},
        )
    )
    assert sorted((r.source_code, r.source_review_id, r.rating) for r in got.collect()) == [
        ("app_store", "a", 2),
        ("app_store", "b", 5),
        ("trustpilot", "a", 3),
    ]


def test_latency_counts_calendar_days(spark):
    got = star.staged(
        raw(
            spark,
            {"review_date": dt.datetime(2024, 1, 10, 23), "vendor_response_at": dt.datetime(2024, 1, 11, 1)},
            {"vendor_response_at": dt.datetime(2024, 1, 8), "vendor_response": "merci"},
            {"vendor_response": "merci"},
        )
    ).orderBy("source_review_id")
    assert [(r.response_latency_days, r.vendor_responded) for r in got.collect()] == [
        (1, False), (-2, True), (None, True),
    ]


def test_unknown_source_stays_in_reviews_and_leaves_classifications(spark, seeds):
    rows = star.numbered_reviews(
        star.classified_reviews(
            raw(spark, {"source_code": "forum"}, {}, {"source_review_id": None}, {"category_code": "autre"}),
            seeds,
        )
    )
    facts = star.fact_reviews(rows)
    classes = star.fact_classifications(rows)
    assert facts.count() == 4
    assert sorted(r.id for r in classes.collect()) == [1, 2]
    assert {r.category_id for r in classes.collect()} == {4, None}
    assert facts.columns == list(schemas.FACT_REVIEWS)
    assert classes.columns == list(schemas.FACT_CLASSIFICATIONS)


def test_review_keys_are_stable_and_keep_null_apart(spark, seeds):
    first = star.classified_reviews(raw(spark, {}, {}, {}), seeds)
    later = star.classified_reviews(raw(spark, {}, {}, {"source_review_id": None}, {"source_review_id": ""}), seeds)
    keys = lambda df: {r.source_review_id: r.review_key for r in df.collect()}
    assert keys(first)["1"] == keys(later)["1"]
    assert len(set(keys(later).values())) == 4


def test_calendar(spark):
    days = {r.date: r for r in star.calendar(spark).collect()}
    assert len(days) == 1096
    odd = days[dt.date(2024, 12, 30)]
    assert (odd.date_id, odd.year, odd.quarter, odd.week, odd.day_of_week) == (20241230, 2024, 4, 1, 1)
    assert days[dt.date(2024, 12, 29)].day_of_week == 0
    assert days[dt.date(2024, 12, 29)].is_weekend and days[dt.date(2024, 12, 28)].is_weekend


def test_synthesis(spark, seeds):
    day = {"review_date": dt.datetime(2024, 1, 10)}
    table = star.classified_reviews(
        raw(
            spark,
            *[{**day, "rating": r} for r in (2, 2, 2, 2, 2, 2, 2, 3)],  # mean 2.125
            {**day, "brand_code": "airbnb", "rating": 4},
            {**day, "brand_code": "booking", "rating": 1},
            {**day, "brand_code": "booking", "rating": 2, "severity_code": "high"},
            {**day, "rating": 1, "is_exploitable": False},
            {"review_date": dt.datetime(2024, 1, 11), "rating": None},
        ),
        seeds,
    )
    got = {(r.date_id, r.brand_label): r for r in marts.direction_synthesis(table, seeds).collect()}
    focus = got[20240110, "Abritel"]
    # Half away from zero, and the gap is taken before rounding: 2.125 - (4 + 1.5) / 2.
    assert (focus.total_reviews, focus.avg_rating, focus.gap_vs_competitors) == (8, 2.13, -0.63)
    assert got[20240110, "Booking"].share_critical == 0.5
    assert got[20240110, "Booking"].gap_vs_competitors is None
    alone = got[20240111, "Abritel"]
    assert (alone.total_reviews, alone.avg_rating, alone.gap_vs_competitors) == (1, None, None)

    closed = table.where("severity_code = 'high'").select("review_key", F.lit(3).alias("status_id"))
    rated = marts.direction_synthesis(table, seeds, closed).collect()
    assert {(r.date_id, r.ticket_resolution_rate) for r in rated} == {(20240110, 1.0), (20240111, 0.0)}


def test_days_open_are_whole_days(spark, seeds):
    table = star.numbered_reviews(
        star.classified_reviews(
            raw(spark, {"severity_code": "high", "collected_at": dt.datetime(2024, 1, 1, 2)}), seeds
        )
    )
    rows = star.numbered_tickets(table, seeds)
    as_of = F.lit("2024-03-05 01:00:00").cast("timestamp")
    assert [r.days_open for r in marts.support_tickets(rows, seeds, as_of).collect()] == [63]


def test_ticket_numbers_grow_past_four_digits(spark):
    df = spark.createDataFrame([(1,), (9999,), (10000,), (123456,)], "n long")
    got = [r[0] for r in df.select(activation.ticket_number(F.col("n"))).collect()]
    assert got == ["TICK-0001", "TICK-9999", "TICK-10000", "TICK-123456"]


def test_invariants(spark, sf_dir):
    rows = catalog.numbered(spark, sf_dir)
    n = rows.count()
    assert rows.select("source_code", "source_review_id").distinct().count() == n
    assert rows.select("review_key").distinct().count() == n
    assert rows.agg(F.min("id"), F.max("id")).first() == (1, n)
    usable = rows.where("is_exploitable").count()
    seeds = reference_data.seeds(spark)
    total = marts.direction_synthesis(rows, seeds).agg(F.sum("total_reviews")).first()[0]
    assert total == usable
    assert marts.marketing_cells(rows).agg(F.sum("review_count")).first()[0] == usable
    tickets = activation.critical_selection(rows, seeds).select("review_id")
    assert star.fact_tickets(star.numbered_tickets(rows, seeds)).join(
        tickets, "review_id", "left_anti"
    ).isEmpty()


@pytest.mark.parametrize("parts", [1, 37])
def test_marts_ignore_order_and_partitioning(spark, sf_dir, seeds, parts):
    table = catalog.raw_reviews(spark, sf_dir)
    mixed = table.orderBy(F.xxhash64("source_review_id", "collected_at")).repartition(parts)
    for build in (marts.direction_synthesis, marts.marketing_voice, activation.weekly_high):
        a = build(star.classified_reviews(table, seeds), seeds).collect()
        b = build(star.classified_reviews(mixed, seeds), seeds).collect()
        assert sorted(map(str, a)) == sorted(map(str, b))
