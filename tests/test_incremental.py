"""The star by touched month equals the star rebuilt from all history."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from avisgrid import schemas
from avisgrid.plans import daily, incremental, marts, star
from avisgrid.session import spread, written
from avisgrid.sources import fixture as fx
from avisgrid.sources import reference_data, tables

BASE = dt.datetime(2024, 1, 15)


def version(rng, key, collected):
    """A raw row with few different values, so that versions tie and months change."""
    date = None if rng.random() < 0.1 else BASE + dt.timedelta(days=rng.randrange(-40, 80), seconds=rng.randrange(3))
    return {
        "source_review_id": key if rng.random() < 0.97 else None,
        "source_code": rng.choice(["app_store", "trustpilot", "forum", None]),
        "brand_code": rng.choice(["abritel", "airbnb", "booking", None]),
        "review_date": date,
        "rating": rng.choice([None, 1, 2, 5]),
        "text": f"texte {rng.randrange(1000)}",
        "collected_at": collected,
        "is_exploitable": rng.random() < 0.8,
        "category_code": rng.choice(["service_client", "parcours_paiement", "non_classe", "autre"]),
        "category_source": "heuristic",
        "persona_code": rng.choice(["locataire", "proprietaire"]),
        "severity_code": rng.choice(["low", "medium", "high", "inconnue"]),
        "severity_rating_score": 0.5,
        "severity_text_score": 0.0,
        "classified_at": BASE,
    }


def frame(spark, rows):
    """One row per natural key, as a run has it."""
    unique = {(r["source_code"], r["source_review_id"]): r for r in rows}
    names = schemas.RAW.fieldNames()
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in unique.values()], schemas.RAW)


@pytest.fixture
def seeds(spark):
    return reference_data.seeds(spark)


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def check(spark, raw, store, seeds):
    whole = star.classified_reviews(tables.read(spark, raw, schemas.RAW_RUNS), seeds)
    base = star.numbered_reviews(whole)
    kept = incremental.reviews(spark, store, seeds)
    assert rows(star.fact_reviews(kept)) == rows(star.fact_reviews(base))
    assert rows(star.fact_classifications(kept)) == rows(star.fact_classifications(base))
    for cube, cells, mart in (
        ("direction", marts.daily_cells(whole, seeds), marts.synthesis_of),
        ("marketing", marts.marketing_cells(whole), marts.voice_of),
    ):
        now = incremental.cells(spark, store, cube, seeds)
        assert rows(now) == rows(cells)
        assert rows(mart(now, seeds)) == rows(mart(cells, seeds))


def test_runs_with_ties_moves_reloads_and_empty_ones(spark, tmp_path, seeds):
    rng = random.Random(3)
    raw, store = f"{tmp_path}/raw", f"{tmp_path}/star"
    keys = [str(i) for i in range(60)]
    for step, run in enumerate(["r2", "r1", "r3", "r1", "r4", "r3", "r2"]):
        collected = BASE + dt.timedelta(days=40 + rng.randrange(2))
        chosen = [] if step in (4, 5) else [k for k in keys if rng.random() < 0.5]
        run_rows = frame(spark, [version(rng, k, collected) for k in chosen])
        tables.load_raw_run(run_rows, raw, run, f"landed {step}")
        incremental.advance(spark, raw, store, seeds, buckets=3)
        if step in (0, 2, 3, 5, 6):
            check(spark, raw, store, seeds)
    assert incremental.advance(spark, raw, store, seeds) == []


def dated(key, day, text="un avis"):
    row = version(random.Random(1), key, BASE + dt.timedelta(days=60))
    return row | {"source_review_id": key, "source_code": "app_store", "review_date": BASE + dt.timedelta(days=day), "text": text}


def test_other_months_are_neither_read_nor_written(spark, tmp_path, seeds, monkeypatch):
    raw, store = f"{tmp_path}/raw", f"{tmp_path}/star"
    tables.load_raw_run(frame(spark, [dated(str(d), d) for d in range(0, 120, 3)]), raw, "r1", "1")
    assert incremental.advance(spark, raw, store, seeds) == ["2024-01", "2024-02", "2024-03", "2024-04", "2024-05"]
    before = tables.entries(spark, store)
    late = dated("3", 31, "plus tard") | {"collected_at": BASE + dt.timedelta(days=70)}
    tables.load_raw_run(frame(spark, [late, dated("new", 20)]), raw, "r2", "2")
    read, plain = [], tables.read
    monkeypatch.setattr(tables, "read", lambda *a, **k: read.append(plain(*a, **k)) or read[-1])
    # One review leaves January for February, one is new there.
    assert incremental.advance(spark, raw, store, seeds) == ["2024-01", "2024-02"]
    files = {f for df in read for f in df.inputFiles()}
    assert files and not any(f"part=2024-0{m}" in f for f in files for m in (3, 4, 5))
    after = tables.entries(spark, store)
    for part, entry in before.items():
        if part.split("=")[-1] in ("2024-03", "2024-04", "2024-05"):
            assert after[part].folder == entry.folder
    check(spark, raw, store, seeds)


def test_the_history_is_not_shuffled(spark, tmp_path, seeds):
    raw, store = f"{tmp_path}/raw", f"{tmp_path}/star"
    tables.load_raw_run(frame(spark, [dated(str(d), d) for d in range(50)]), raw, "r1", "1")
    incremental.advance(spark, raw, store, seeds, buckets=5)
    state = incremental.newest(spark, store)
    known = incremental.reviews(spark, store, seeds).withColumn("run_id", F.lit("r9"))
    arrived = written(incremental._versions(known), "arrived")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for replaced in ([], ["r1"]):
            changes = incremental.changed_versions(state, arrived, replaced)
            merged = incremental.merged_versions(state, written(changes, "changes"))
            for df in (changes, merged):
                text = df._jdf.queryExecution().executedPlan().toString()
                depth, moved, scans = [], 0, 0
                for line in text.splitlines():
                    at = len(line) - len(line.lstrip(" :+-"))
                    depth = [(d, n) for d, n in depth if d < at] + [(at, line.strip(" :+-"))]
                    if re.search(r"FileScan .*bucketed_", line):
                        scans += 1
                        moved += any(n.startswith("Exchange") for _, n in depth)
                assert (scans, moved) == (1, 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_failed_step_leaves_the_store_and_is_made_up_for(spark, tmp_path, seeds, monkeypatch):
    raw, store = f"{tmp_path}/raw", f"{tmp_path}/star"
    tables.load_raw_run(frame(spark, [dated(str(d), d) for d in range(20)]), raw, "r1", "1")
    incremental.advance(spark, raw, store, seeds)
    before = tables.entries(spark, store)
    tables.load_raw_run(frame(spark, [dated(str(d), d + 1, "autre") for d in range(5, 30)]), raw, "r2", "2")
    with monkeypatch.context() as m:
        m.setattr(incremental, "deltas", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            incremental.advance(spark, raw, store, seeds)
    assert tables.entries(spark, store) == before
    incremental.advance(spark, raw, store, seeds)
    check(spark, raw, store, seeds)
    assert tables.vacuum(spark, store) > 0
    check(spark, raw, store, seeds)


def test_an_incremental_day_is_a_day(spark, sf_dir, tmp_path):
    payloads = fx.payloads(spark, sf_dir)
    houses = [daily.Warehouse(spark, f"{tmp_path}/{k}", k == 1) for k in (0, 1)]
    recaps = [
        daily.run_day(spark, payloads, h.root, "20240210T000000Z", fx.ts(fx.AS_OF), incrementally=h.incremental).first()
        for h in houses
    ]
    assert recaps[0] == recaps[1]
    seeds = reference_data.seeds(spark)
    for name in ("fact_reviews", "fact_classifications", "fact_tickets", "dm_direction_synthese", "dm_marketing_voc"):
        assert rows(houses[0].fact(name, seeds)) == rows(houses[1].fact(name, seeds)), name


def test_first_merge_writes_one_file_for_each_bucket(spark, tmp_path, seeds):
    rng = random.Random(4)
    raw, store = str(tmp_path / "raw"), str(tmp_path / "star")
    first = frame(spark, [version(rng, f"r{i}", BASE) for i in range(400)]).repartition(6)
    tables.load_raw_run(first, raw, "r1", "landed-0")
    incremental.advance(spark, raw, store, seeds, buckets=3)
    folder = tables.entries(spark, store)["newest"].folder.rsplit("/data/", 1)[1]
    assert 0 < len(list((tmp_path / "star" / "data" / folder).glob("*.parquet"))) <= 3
    check(spark, raw, store, seeds)


def test_one_file_is_spread_over_all_cores(spark):
    one = spark.range(5000).coalesce(1)
    dealt = spread(one, "id")
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows(dealt) == rows(one)
