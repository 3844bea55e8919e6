"""Payload files, windows, runs and the raw table."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from avisgrid import schemas
from avisgrid.functions import classify as cl
from avisgrid.functions import times
from avisgrid.operators import landing
from avisgrid.sources import payloads as pl
from avisgrid.sources import reference_data, tables

UTC = dt.timezone.utc


def stamp(text):
    return F.lit(text).cast("timestamp")


def one(spark, payload, brand="abritel", page=1):
    return spark.createDataFrame([(brand, page, payload)], "brand_code string, arrival_page long, payload string")


def entry(**over):
    base = {
        "im:rating": {"label": "4"},
        "updated": {"label": "2024-05-01T10:20:30-07:00"},
        "id": {"label": "77"},
        "title": {"label": "Bien"},
        "content": {"label": "Très bien"},
        "author": {"name": {"label": "Zoé"}, "uri": {"label": "x"}},
        "im:version": {"label": "9.1"},
    }
    base.update(over)
    return {k: v for k, v in base.items() if v is not None}


def test_app_store(spark):
    feed = {
        "feed": {
            "entry": [
                entry(),
                entry(**{"im:rating": None}),
                entry(updated={"label": "hier"}),
                entry(id=None),
                entry(author=None, title=None),
            ]
        }
    }
    rows = pl.app_store_reviews(one(spark, json.dumps(feed))).orderBy("arrival_pos").collect()
    assert [(r.source_review_id, r.rating, r.text, r.author_handle) for r in rows] == [
        ("77", 4, "Bien. Très bien", "Zoé"),
        ("as_2024-05-01T17:20:30+00:00", 4, "Bien. Très bien", "Zoé"),
        ("77", 4, "Très bien", None),
    ]
    assert rows[0].review_date == dt.datetime(2024, 5, 1, 17, 20, 30)
    for broken in ("", "{", "[]", '{"feed": {}}', json.dumps(feed) + " x"):
        assert pl.app_store_reviews(one(spark, broken)).count() == 0


def page(reviews, attrs='id="__NEXT_DATA__" type="application/json"'):
    state = json.dumps({"props": {"pageProps": {"reviews": reviews}}}, ensure_ascii=False)
    return f"<html><script>var a = 1 < 2;</script><SCRIPT {attrs}>{state}</SCRIPT></html>"


def test_trustpilot(spark):
    when = {"dates": {"publishedDate": "2024-05-01T10:20:30.000Z"}}
    reviews = [
        {"id": "a", "rating": 1, "title": "Non", "text": "jamais", **when,
         "consumer": {"displayName": "Léa"},
         "reply": {"message": "Désolé", "publishedDate": "2024-05-03T00:00:00Z"}},
        {"id": "b", "title": "", "text": "", **when, "consumer": None, "reply": None},
        {"id": "c", "rating": None, "text": "x", **when},
        {"id": "d", "rating": 5, "dates": {"publishedDate": ""}},
        {"rating": 5, **when},
    ]
    rows = pl.trustpilot_reviews(one(spark, page(reviews))).orderBy("arrival_pos").collect()
    assert [(r.source_review_id, r.rating, r.text, r.vendor_response) for r in rows] == [
        ("a", 1, "Non. jamais", "Désolé"),
        ("b", 0, "(sans commentaire)", None),
        ("c", None, "x", None),
        ("tp_2024-05-01T10:20:30+00:00", 5, "(sans commentaire)", None),
    ]
    assert rows[0].vendor_response_at == dt.datetime(2024, 5, 3)
    for attrs in ("type='x' id='__NEXT_DATA__'", "id=__NEXT_DATA__"):
        assert pl.trustpilot_reviews(one(spark, page(reviews, attrs))).count() == 4
    for broken in ("", "<html></html>", page(reviews, 'id="other"'), page(reviews)[:-30]):
        assert pl.trustpilot_reviews(one(spark, broken)).count() == 0


def test_google_play(spark):
    batch = [
        {"reviewId": "g1", "at": "2024-05-01 10:20:30", "score": 2, "content": "  bof bof ",
         "userName": "", "reviewCreatedVersion": "", "replyContent": "", "repliedAt": None},
        {"reviewId": "", "at": "2024-05-01 10:20:30", "score": 3, "content": " ", "userName": "Max",
         "reviewCreatedVersion": "1.0", "replyContent": "merci", "repliedAt": "2024-05-02 00:00:00"},
    ]
    rows = pl.google_play_reviews(one(spark, json.dumps(batch))).orderBy("arrival_pos").collect()
    assert [tuple(r)[0:1] + (r.text, r.author_handle, r.app_version, r.vendor_response) for r in rows] == [
        ("g1", "bof bof", None, None, None),
        ("gp_2024-05-01T10:20:30", "(sans commentaire)", "Max", "1.0", "merci"),
    ]


def test_payload_files(spark, tmp_path):
    folder = tmp_path / "brand_code=airbnb" / "arrival_page=3"
    folder.mkdir(parents=True)
    (folder / "feed.json").write_text(json.dumps({"feed": {"entry": [entry()]}}, indent=1))
    rows = pl.app_store_reviews(pl.read_payload_files(spark, str(tmp_path))).collect()
    assert [(r.brand_code, r.arrival_page, r.source_review_id) for r in rows] == [("airbnb", 3, "77")]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-05-01T10:20:30.000Z", dt.datetime(2024, 5, 1, 10, 20, 30)),
        ("2024-05-01T10:20:30-07:00", dt.datetime(2024, 5, 1, 17, 20, 30)),
        ("2024-05-01 10:20:30", dt.datetime(2024, 5, 1, 10, 20, 30)),
        ("2024-05-01", dt.datetime(2024, 5, 1)),
        ("20240501", dt.datetime(2024, 5, 1)),
        ("Wed, 01 May 2024 10:20:30 +0200", dt.datetime(2024, 5, 1, 8, 20, 30)),
        ("2024/05/01", dt.datetime(2024, 5, 1)),
        ("05/31/2024", dt.datetime(2024, 5, 31)),
        ("", None),
        ("hier", None),
        ("2024-02-30", None),
        (None, None),
    ],
)
def test_parse_time(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(times.parse_ts_utc(F.col("t"))).first()[0] == expected


def test_window_is_inclusive_and_uses_paris_dates(spark):
    df = spark.createDataFrame(
        [("2024-01-10 22:59:59",), ("2024-01-10 23:00:00",), ("2024-02-09 12:00:00",)], "t string"
    ).select(F.col("t").cast("timestamp").alias("review_date"))
    kept = landing.recent(df, stamp("2024-02-10 00:00:00"), 30)
    assert kept.count() == 2


def test_missing_source_columns_become_null(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2,)], "a int")
    assert sorted(map(tuple, landing.union_sources([a, b]).collect())) == [(1, "x"), (2, None)]


def landed(spark, n):
    rows = [(str(i), "abritel", "app_store", f"texte numéro {i}", i % 5 + 1) for i in range(n)]
    df = spark.createDataFrame(
        rows, "source_review_id string, brand_code string, source_code string, text string, rating int"
    )
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schemas.LANDED.fields
        ]
    )


def test_runs(spark, tmp_path):
    bronze = str(tmp_path / "bronze")
    with pytest.raises(tables.NoRunError):
        tables.read_run(spark, bronze)
    tables.write_run(landed(spark, 3), bronze, "20240101T000000Z")
    tables.write_run(landed(spark, 5), bronze, "20240102T000000Z")
    assert tables.read_run(spark, bronze).count() == 5
    assert tables.read_run(spark, bronze, "20240101T000000Z").count() == 3
    files = tables.read_run(spark, bronze).inputFiles()
    assert files and all("run_id=20240102T000000Z" in f for f in files)
    tables.write_run(landed(spark, 0), bronze, "20240103T000000Z")
    assert tables.read_run(spark, bronze).count() == 0


def test_empty_batch_keeps_the_raw_table(spark, tmp_path):
    path = str(tmp_path / "raw")

    def refined(n):
        return cl.refine(landed(spark, n), stamp("2024-01-01 00:00:00"))

    assert tables.write_raw(refined(4), path) == 4
    assert tables.write_raw(refined(0), path) == 0
    assert tables.read(spark, path).count() == 4
    assert tables.read(spark, path).columns == schemas.RAW.fieldNames()


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,), (None,)], "severity_text_score double")
    got = [r.severity_text_score for r in tables.raw_columns(df).collect()]
    assert got == [None, 1.5, None]


def test_csv_has_a_header_without_rows(spark, tmp_path):
    path = tmp_path / "alerts.csv"
    empty = spark.createDataFrame([], "alert_id string, ratio double")
    tables.write_csv(empty, str(path))
    written = "".join(p.read_text() for p in path.glob("*.csv"))
    assert written == "alert_id,ratio\n"


def test_seed_folder(spark, tmp_path):
    (tmp_path / "severities.csv").write_text("id,code,label,rank\n9,urgent,Urgente,4\n")
    got = reference_data.seed(spark, "severities", str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(9, "urgent", "Urgente", 4)]
    assert reference_data.seed(spark, "severities").count() == 3
