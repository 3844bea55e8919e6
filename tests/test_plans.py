"""Shapes of the physical plans that must hold at any size of the data."""

import re

import pytest

from avisgrid import catalog
from avisgrid.operators import landing
from avisgrid.plans import activation, marts, star
from avisgrid.sources import fixture as fx
from avisgrid.sources import reference_data


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw"))
    catalog.raw_reviews(spark, sf_dir).write.mode("overwrite").parquet(path)
    raw = spark.read.parquet(path)
    seeds = reference_data.seeds(spark)
    return raw, star.classified_reviews(raw, seeds), seeds


def read_columns(text):
    return [set(c.split(",")) for c in re.findall(r"FileScan parquet \[([^\]]*)\]", re.sub(r"#\d+L?", "", text))]


def test_refinement_is_one_narrow_jvm_stage(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("text", "1 AS rating")
    text = plan(catalog.cl.with_text_classes(raw))
    assert "Exchange" not in text and "Python" not in text
    # The folded text is computed in one projection only.
    assert text.count("translate(") == 1


@pytest.mark.parametrize(
    "build", [marts.direction_synthesis, marts.marketing_voice, activation.weekly_high]
)
def test_marts_read_no_text_and_broadcast_by_size(tables, build):
    _, rows, seeds = tables
    text = plan(build(rows, seeds))
    for columns in read_columns(text):
        assert not columns & {"text", "vendor_response", "author_handle"}
    assert len(read_columns(text)) == 1  # one pass over the reviews
    assert "SortMergeJoin" not in text
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "partial_count" in text


def test_beyond_the_broadcast_size_joins_shuffle(spark, tables):
    raw, _, seeds = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(star.classified_reviews(raw, seeds))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in text and "SortMergeJoin" in text


def test_deduplication_limits_before_the_shuffle(tables):
    raw, _, _ = tables
    text = plan(star.staged(raw))
    assert text.count("Exchange") == 1
    assert [m for m in re.findall(r"row_number\(\), 1, (\w+)", text)] == ["Final", "Partial"]


def test_cap_ranks_a_stretch_only(spark, sf_dir):
    text = plan(landing.capped(fx.arrived_reviews(spark, sf_dir), 100))
    window = text[text.index("Window ["):]
    # What is ranked is filtered by the cut first; the rest passes without a shuffle by group.
    assert "_at" in window[: window.index("FileScan")] and text.count("Window [") == 1


def test_usable_filter_reaches_the_scan(spark, tables):
    """Facts are filtered while they are read, before anything is joined."""
    raw, rows, seeds = tables
    written = star.numbered_reviews(rows)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(marts.finance_disputes(written, seeds))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(is_exploitable,true\)", text)


def test_no_query_collects_rows_in_python():
    import inspect

    from avisgrid.operators import ranking, verdicts
    from avisgrid.plans import star as s

    for module in (catalog, ranking, verdicts, s, marts, activation, landing):
        source = inspect.getsource(module)
        assert ".collect(" not in source and "toPandas" not in source
