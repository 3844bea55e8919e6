"""Several feeds, and a lost checkpoint, land into one bronze without losing reviews."""

from pyspark.sql import functions as F
from test_streaming import deliver

from avisgrid.plans import daily
from avisgrid.sources import tables
from avisgrid.streaming.landing import land_new_files


def ids(frame):
    return sorted({r.source_review_id for r in frame.collect()})


def test_feeds_and_lost_checkpoints(spark, tmp_path):
    house = daily.Warehouse(spark, str(tmp_path / "house"))
    as_of = F.lit("2024-02-10 06:00:00").cast("timestamp")

    def land(feed, checkpoint):
        return land_new_files(spark, str(tmp_path / feed), house.bronze, str(tmp_path / checkpoint), as_of)

    deliver(tmp_path / "one", 1, ["a"])
    deliver(tmp_path / "two", 1, ["b"])
    assert land("one", "c1") == ["batch-000000"]
    second = land("two", "c2")
    assert len(tables.run_ids(spark, house.bronze)) == 2 and second != ["batch-000000"]
    assert daily.load_run(house, as_of) == 2 and ids(daily.read_raw(house)) == ["a", "b"]
    assert daily.load_run(house, as_of) == 0

    deliver(tmp_path / "one", 2, ["c"])
    assert land("one", "lost") == ["batch-000000"]
    assert daily.load_run(house, as_of) == 2 and ids(daily.read_raw(house)) == ["a", "b", "c"]

    deliver(tmp_path / "moved", 3, ["d"])  # the old pages are gone
    land("moved", "lost too")
    daily.load_run(house, as_of)
    assert ids(daily.read_raw(house)) == ["a", "b", "c", "d"]
