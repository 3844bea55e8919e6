"""The daily run end to end on files."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from avisgrid import schemas
from avisgrid.plans import daily, quality
from avisgrid.sources import fixture as fx
from avisgrid.sources import reference_data, tables


def as_of():
    return fx.ts(fx.AS_OF)


@pytest.fixture(scope="module")
def payloads(spark, sf_dir):
    return fx.payloads(spark, sf_dir)


def test_two_days(spark, payloads, tmp_path):
    root = str(tmp_path)
    house = daily.Warehouse(spark, root)
    first = daily.run_day(spark, payloads, root, "20240210T000000Z", as_of(), fx.scripted_scorer).first()
    raw = house.read("raw_reviews")
    assert raw.columns == schemas.RAW_RUNS.fieldNames()
    assert {r.category_source for r in raw.select("category_source").distinct().collect()} == {
        "heuristic", "llm",
    }
    n = raw.count()
    assert house.read("fact_reviews").count() == n
    assert house.read("fact_classifications").count() == n
    n_tickets = house.read("fact_tickets").count()
    assert 0 < n_tickets == house.read("dm_sav_tickets").count() == house.read("tickets").count()
    assert (first.csv_tickets, first.new_tickets) == (n_tickets, n_tickets)
    csv = spark.read.csv(house.path("tickets.csv"), header=True, multiLine=True)
    assert csv.columns == list(schemas.TICKETS) and csv.count() == n_tickets
    assert spark.read.csv(house.path("alerts.csv"), header=True).columns == list(schemas.ALERTS)

    # The same day again repeats its result; the next day has no new tickets.
    again = daily.run_day(spark, payloads, root, "20240210T000000Z", as_of(), fx.scripted_scorer).first()
    assert again == first
    second = daily.run_day(spark, payloads, root, "20240211T000000Z", as_of(), fx.scripted_scorer).first()
    assert (second.csv_tickets, second.new_tickets) == (n_tickets, 0)
    status = {r.run_id: (r.step, r.error) for r in house.read("run_status").collect()}
    assert status == {"20240210T000000Z": ("recap", None), "20240211T000000Z": ("recap", None)}
    stats = {r.run_id: r for r in house.read("verdict_stats").collect()}
    assert stats["20240210T000000Z"].updated == raw.where("run_id = '20240210T000000Z' AND category_source = 'llm'").count() > 0
    assert all(r.candidates == r.updated + r.skipped for r in stats.values())
    counts = house.read("reading_counts").where("run_id = '20240211T000000Z'")
    assert {r.source_code for r in counts.collect()} == set(payloads) and counts.where("outcome <> 'kept'").count() > 2
    assert house.read("ticket_payloads/run_id=20240211T000000Z").count() == 0


def test_failed_checks_stop_activation(spark, payloads, tmp_path):
    root = str(tmp_path)
    broken = {
        s: p.withColumn("brand_code", F.when(F.col("brand_code") == "airbnb", "inconnu").otherwise(F.col("brand_code")))
        for s, p in payloads.items()
        if s == "app_store"
    }
    with pytest.raises(quality.QualityGateError, match="brand_code"):
        daily.run_day(spark, broken, root, "20240210T000000Z", as_of())
    house = daily.Warehouse(spark, root)
    assert house.read("quality_report").where("failures > 0").count() >= 2
    assert house.read("recap").isEmpty()
    assert not (tmp_path / "alerts.csv").exists() and not (tmp_path / "tickets.csv").exists()


def test_empty_day_writes_an_empty_run_and_keeps_the_raw_table(spark, payloads, tmp_path):
    house = daily.Warehouse(spark, str(tmp_path))
    daily.land_run(house, payloads, "20240210T000000Z", as_of())
    n = daily.load_run(house, as_of())
    assert n > 0
    late = F.lit("2030-01-01").cast("timestamp")
    daily.land_run(house, payloads, "20300101T000000Z", late)
    assert daily.load_run(house, late) == 0
    assert house.read("raw_reviews").count() == n


def test_runs_add_up_and_a_broken_step_renews_the_recap(spark, payloads, tmp_path, monkeypatch):
    house = daily.Warehouse(spark, str(tmp_path))
    parts = [{s: p.where(F.col("arrival_page") % 2 == k) for s, p in payloads.items()} for k in (0, 1)]
    for k, part in enumerate(parts):
        daily.land_run(house, part, f"r{k}", as_of())
    both = daily.load_run(house, as_of())  # the first run was never loaded on its own
    assert daily.read_raw(house).count() == both
    assert {r.run_id for r in daily.read_raw(house).select("run_id").distinct().collect()} == {"r0", "r1"}
    assert daily.load_run(house, as_of()) == 0
    assert daily.load_run(house, as_of(), "r1") > 0
    assert daily.read_raw(house).count() == both
    for step in ("land_run", "build_marts", "route_tickets"):
        house.write("recap", spark.createDataFrame([(1, 1, 1, "old")], house_recap_schema()))
        with monkeypatch.context() as m:
            m.setattr(daily, step, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                daily.run_day(spark, payloads, str(tmp_path), "r2", as_of())
        assert house.read("recap").isEmpty()
        status = house.read("run_status").first()
        assert (status.run_id, status.step) == ("r2", {"land_run": "land", "build_marts": "marts", "route_tickets": "tickets"}[step])
        assert "ZeroDivisionError" in status.error
    with monkeypatch.context() as m:  # the first error is the one that is raised
        m.setattr(daily, "land_run", lambda *a, **k: 1 / 0)
        m.setattr(daily.activation, "empty_recap", lambda s: [][0])
        with pytest.raises(ZeroDivisionError) as caught:
            daily.run_day(spark, payloads, str(tmp_path), "r2", as_of())
    assert any("could not be noted" in note for note in caught.value.__notes__)


def house_recap_schema():
    return "csv_tickets bigint, new_tickets bigint, alerts bigint, message string"


def test_all_reviews_are_landed_by_default(spark, tmp_path):
    rows = [
        {"reviewId": str(i), "at": "2024-02-01 10:00:00", "score": 4.0, "content": f"avis numéro {i}"}
        for i in range(150)
    ]
    page = spark.createDataFrame([("abritel", 1, json.dumps(rows)), ("abritel", 2, json.dumps(rows[:1]) + " x")],
                                 "brand_code string, arrival_page bigint, payload string")
    house = daily.Warehouse(spark, str(tmp_path))
    daily.land_run(house, {"google_play": page}, "r", F.lit("2024-02-10").cast("timestamp"))
    landed = tables.read_run(spark, house.bronze).collect()
    assert len(landed) == 150 and {r.rating for r in landed} == {4}


def test_exports_are_plain_csv(spark, tmp_path):
    said = ['il a dit "non, merci"', "  deux\nlignes, et des blancs  ", None, "l'hôte \\ \"x\\\""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").coalesce(1)
    tables.write_csv(df, str(tmp_path / "x.csv"))
    part = next((tmp_path / "x.csv").glob("part-*"))
    with part.open(newline="", encoding="utf-8") as f:
        rows = list(csv.reader(f))
    assert rows == [["i", "t"], *[[str(i), t or ""] for i, t in enumerate(said)]]
    back = tables.read_csv(spark, str(tmp_path / "x.csv"), "i int, t string").orderBy("i").collect()
    assert [r.t for r in back] == said


def test_replaced_seed_files_are_read_anew(spark, tmp_path):
    seed = tmp_path / "personas.csv"
    for n in (2, 5):
        seed.write_text("id,code,label\n" + "".join(f"{i},c{i},Persona {i}\n" for i in range(n)))
        assert reference_data.seed(spark, "personas", str(tmp_path)).count() == n


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    house = daily.Warehouse(spark, str(tmp_path))
    house.write("part=1/t", spark.range(5))
    broken = spark.range(3).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    for write in (lambda: house.write("part=1/t", broken), lambda: tables.write_csv(broken, str(tmp_path / "part=1" / "t"))):
        with pytest.raises(Exception, match="broken"):
            write()
    assert house.read("part=1/t").count() == 5
    house.write("part=1/t", house.read("part=1/t").filter("id > 1"))  # reads what it replaces
    assert house.read("part=1/t").count() == 3
    tables.write_csv(spark.range(2), str(tmp_path / "x.csv"))
    tables.write_csv(spark.range(4), str(tmp_path / "x.csv"))
    assert tables.read_csv(spark, str(tmp_path / "x.csv"), "id bigint").count() == 4
