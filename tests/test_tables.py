"""Committed tables: readers see one state or the next, failures leave the old one."""

import threading

import pytest
from pyspark.sql import functions as F

from avisgrid import schemas
from avisgrid.plans import daily
from avisgrid.sources import fixture as fx
from avisgrid.sources import tables


def test_a_reader_never_misses_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.put(spark.range(1), path)
    seen, stop = [], threading.Event()

    def watch():
        while not stop.is_set():
            seen.append(tables.read(spark, path).count())

    reader = threading.Thread(target=watch)
    reader.start()
    for n in range(2, 8):
        tables.put(spark.range(n), path)
    stop.set()
    reader.join()
    assert seen == sorted(seen) and set(seen) <= set(range(1, 8)) and len(seen) > 1
    assert tables.vacuum(spark, path) == 6 and tables.read(spark, path).count() == 7


def test_parts_change_together(spark, tmp_path):
    path = str(tmp_path / "t")
    for part, n in (("a", 1), ("b", 2)):
        tables.put(spark.range(n), path, part)
    assert tables.read(spark, path).count() == 3 and tables.read(spark, path, parts=["b"]).count() == 2
    folder = tables.new_folder(path, "b")
    spark.range(10).write.parquet(folder)
    assert tables.read(spark, path).count() == 3  # nothing is seen before the commit
    tables.commit(spark, path, {"a": (None, "gone"), "b": (folder, None)})
    assert tables.read(spark, path).count() == 10
    with pytest.raises(tables.NoTableError):
        tables.read(spark, str(tmp_path / "none"))
    assert tables.read(spark, str(tmp_path / "none"), "id bigint").count() == 0


def test_exports_come_back_when_they_cannot_be_replaced(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    tables.write_csv(spark.range(2), path)
    broken = spark.range(3).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="broken"):
        tables.write_csv(broken, path)
    assert tables.read_csv(spark, path, "id bigint").count() == 2
    tables.write_csv(spark.range(4), path)
    assert tables.read_csv(spark, path, "id bigint").count() == 4
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("_old")] == []


def test_empty_and_emptied_runs(spark, sf_dir, tmp_path, monkeypatch):
    house = daily.Warehouse(spark, str(tmp_path))
    landed = fx.landed_reviews(spark, sf_dir).limit(50)
    tables.write_run(landed.where("false"), house.bronze, "r0")
    tables.write_run(landed, house.bronze, "r1")
    assert daily.load_run(house, fx.ts(fx.AS_OF)) == 50
    refined = []
    monkeypatch.setattr(daily.cl, "refine", lambda df, at: refined.append(df) or df)
    assert daily.load_run(house, fx.ts(fx.AS_OF)) == 0 and refined == []  # the empty run is not refined again
    monkeypatch.undo()
    tables.write_run(landed.where("false"), house.bronze, "r1")
    assert daily.load_run(house, fx.ts(fx.AS_OF)) == 0
    assert daily.read_raw(house).count() == 0
    assert daily.read_raw(house).columns == schemas.RAW_RUNS.fieldNames()
