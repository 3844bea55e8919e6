"""Incremental landing reads each payload file once."""

import json

import pytest
from pyspark.sql import functions as F

from avisgrid.sources import tables
from avisgrid.streaming.landing import land_new_files


def deliver(root, page, ids):
    folder = root / "source_code=app_store" / "brand_code=abritel" / f"arrival_page={page}"
    folder.mkdir(parents=True)
    entries = [
        {
            "im:rating": {"label": "2"},
            "updated": {"label": "2024-02-01T10:00:00Z"},
            "id": {"label": i},
            "content": {"label": "Un avis assez long"},
        }
        for i in ids
    ]
    (folder / "feed.json").write_text(json.dumps({"feed": {"entry": entries}}, indent=1))


def test_new_files_only(spark, tmp_path):
    bronze, checkpoint = str(tmp_path / "bronze"), str(tmp_path / "checkpoint")
    pages = tmp_path / "pages"
    as_of = F.lit("2024-02-10 06:00:00").cast("timestamp")

    deliver(pages, 1, ["a", "b", "a"])
    first = land_new_files(spark, str(pages), bronze, checkpoint, as_of)
    assert first == ["batch-000000"]
    assert sorted(r.source_review_id for r in tables.read_run(spark, bronze).collect()) == ["a", "b"]

    assert land_new_files(spark, str(pages), bronze, checkpoint, as_of) == []

    deliver(pages, 2, ["c"])
    second = land_new_files(spark, str(pages), bronze, checkpoint, as_of)
    assert second == ["batch-000001"]
    assert [r.source_review_id for r in tables.read_run(spark, bronze).collect()] == ["c"]


def test_a_repeated_batch_keeps_its_run_and_strange_pages_stop_the_landing(spark, tmp_path):
    bronze, pages = str(tmp_path / "bronze"), tmp_path / "pages"
    deliver(pages, 1, ["a"])
    for day in ("2024-02-10", "2024-02-11"):  # the second checkpoint stands for a lost one
        as_of = F.lit(f"{day} 06:00:00").cast("timestamp")
        assert land_new_files(spark, str(pages), bronze, str(tmp_path / day), as_of) == ["batch-000000"]
    assert tables.run_ids(spark, bronze) == ["batch-000000"]
    folder = pages / "source_code=forum" / "brand_code=abritel" / "arrival_page=1"
    folder.mkdir(parents=True)
    (folder / "feed.json").write_text("{}")
    with pytest.raises(Exception, match="forum"):
        land_new_files(spark, str(pages), bronze, str(tmp_path / "2024-02-11"), as_of)
    assert tables.run_ids(spark, bronze) == ["batch-000000"]
