"""Landed payloads of the three review sources, turned into review rows.

A payload frame has one row per delivered page: ``brand_code``, ``arrival_page`` (order
of delivery inside a source and brand) and ``payload`` (the text as delivered).  Each
parser is a narrow projection and one explode; the size of a page bounds the explode. What gives no
review keeps its row with the reason, so that reading and counting are one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from avisgrid.functions import taxonomy as tx
from avisgrid.functions import text as tt
from avisgrid.functions import times
from avisgrid.functions.strict_json import strict_object, strict_value

REVIEW_COLUMNS = (
    "source_review_id", "brand_code", "source_code", "review_date", "rating", "text",
    "author_handle", "app_version", "vendor_response", "vendor_response_at",
)
ARRIVAL_COLUMNS = ("arrival_page", "arrival_pos")

_LABEL = "struct<label: string>"
APP_STORE_FIELDS = (
    "feed: struct<entry: array<struct<"
    f"`im:rating`: {_LABEL}, updated: {_LABEL}, id: {_LABEL}, title: {_LABEL}, "
    f"content: {_LABEL}, author: struct<name: {_LABEL}>, `im:version`: {_LABEL}>>>"
)
TRUSTPILOT_FIELDS = (
    "props: struct<pageProps: struct<reviews: array<struct<"
    "id: string, rating: variant, title: string, text: string, "
    "dates: struct<publishedDate: string>, consumer: struct<displayName: string>, "
    "reply: struct<message: string, publishedDate: string>>>>>"
)
GOOGLE_PLAY_RECORD = (
    "array<struct<reviewId: string, at: string, score: variant, content: string, "
    "userName: string, reviewCreatedVersion: string, replyContent: string, repliedAt: string>>"
)

# The page state script of a review page; its body is one JSON document.
PAGE_STATE_SCRIPT = (
    r"""(?is)<script\b[^>]*?\bid\s*=\s*["']?__NEXT_DATA__["']?(?=[\s/>])[^>]*>(.*?)</script\s*>"""
)


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Payload files laid out as ``brand_code=<code>/arrival_page=<n>/<file>``."""
    return (
        spark.read.option("basePath", path)
        .text(f"{path}/brand_code=*/arrival_page=*", wholetext=True)
        .select("brand_code", F.col("arrival_page").cast("long"), F.col("value").alias("payload"))
    )


def fallback_id(source_id: Column, prefix: str, when: Column) -> Column:
    """The id of the source, or prefix and time of the review when it has none."""
    return F.coalesce(F.nullif(source_id, F.lit("")), F.concat(F.lit(prefix), when))


# Why a page or an entry gives no review.
NO_STATE, UNREADABLE, EMPTY, NO_RATING, NO_DATE = "no_state", "unreadable_page", "empty_page", "no_rating", "no_date"


def _entries(payloads: DataFrame, entries: Column, unread: Column | None = None) -> DataFrame:
    """One row for each entry with the page's fault, if it has one; a page without entries has one row."""
    fault = F.when(F.col("listed").isNull(), UNREADABLE).when(F.size("listed") == 0, EMPTY)
    pages = payloads.select(
        "brand_code", "arrival_page", entries.alias("listed"), *([unread.alias("unread")] if unread is not None else [])
    )
    fault = fault if unread is None else F.coalesce("unread", fault)
    return pages.select(
        "brand_code", "arrival_page", fault.alias("fault"), F.posexplode_outer("listed").alias("arrival_pos", "e")
    )


def _landed(rows: DataFrame) -> DataFrame:
    return rows.select(*REVIEW_COLUMNS, *ARRIVAL_COLUMNS, "rejected")


def accepted(parsed: DataFrame) -> DataFrame:
    """The reviews among parsed entries."""
    return parsed.where("rejected IS NULL").drop("rejected")


def reading_counts(parsed: dict[str, DataFrame]) -> DataFrame:
    """``source_code, outcome, n``: what was kept of each source and why the rest was not."""
    counts = [
        df.groupBy(F.lit(source).alias("source_code"), F.coalesce("rejected", F.lit("kept")).alias("outcome")).agg(
            F.count("*").alias("n")
        )
        for source, df in parsed.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def parse_app_store(payloads: DataFrame) -> DataFrame:
    """JSON feed pages.  Entries without rating or readable date are rejected."""
    feed = strict_object(F.col("payload"), APP_STORE_FIELDS)["feed"]["entry"]
    e = F.col("e")
    rows = (
        _entries(payloads, feed)
        .withColumn("review_date", times.parse_ts_utc(e["updated"]["label"]))
        .withColumn(
            "rejected",
            F.coalesce(
                "fault",
                F.when(e["im:rating"]["label"].isNull(), NO_RATING).when(F.col("review_date").isNull(), NO_DATE),
            ),
        )
    )
    return _landed(
        rows.select(
            fallback_id(e["id"]["label"], "as_", times.iso_utc(F.col("review_date"))).alias(
                "source_review_id"
            ),
            "brand_code",
            F.lit("app_store").alias("source_code"),
            "review_date",
            e["im:rating"]["label"].try_cast("int").alias("rating"),
            tt.join_title_body(e["title"]["label"], e["content"]["label"]).alias("text"),
            e["author"]["name"]["label"].alias("author_handle"),
            e["im:version"]["label"].alias("app_version"),
            F.lit(None).cast("string").alias("vendor_response"),
            F.lit(None).cast("timestamp").alias("vendor_response_at"),
            *ARRIVAL_COLUMNS,
            "rejected",
        )
    )


def parse_trustpilot(payloads: DataFrame) -> DataFrame:
    """HTML pages carrying their state as JSON.  No or broken state gives no reviews."""
    state = F.regexp_extract(F.col("payload"), PAGE_STATE_SCRIPT, 1)
    page = payloads.withColumn("payload", F.when(F.trim(state) != "", state))
    listed = strict_object(F.col("payload"), TRUSTPILOT_FIELDS)["props"]["pageProps"]["reviews"]
    e = F.col("e")
    rows = (
        _entries(page, listed, F.when(F.col("payload").isNull(), NO_STATE))
        .withColumn("review_date", times.parse_ts_utc(e["dates"]["publishedDate"]))
        .withColumn("rejected", F.coalesce("fault", F.when(F.col("review_date").isNull(), NO_DATE)))
    )
    # Without the field the rating is 0; a written null stays NULL.
    rating = F.when(e["rating"].isNull(), 0).otherwise(
        F.expr("try_variant_get(e.rating, '$', 'int')")
    )
    return _landed(
        rows.select(
            fallback_id(e["id"], "tp_", times.iso_utc(F.col("review_date"))).alias(
                "source_review_id"
            ),
            "brand_code",
            F.lit("trustpilot").alias("source_code"),
            "review_date",
            rating.alias("rating"),
            tt.join_title_body(e["title"], e["text"]).alias("text"),
            e["consumer"]["displayName"].alias("author_handle"),
            F.lit(None).cast("string").alias("app_version"),
            e["reply"]["message"].alias("vendor_response"),
            times.parse_ts_utc(e["reply"]["publishedDate"]).alias("vendor_response_at"),
            *ARRIVAL_COLUMNS,
            "rejected",
        )
    )


def parse_google_play(payloads: DataFrame) -> DataFrame:
    """JSON batches of store records; empty strings count as missing."""
    records = F.from_json(strict_value(F.col("payload")), GOOGLE_PLAY_RECORD)
    e = F.col("e")
    rows = (
        _entries(payloads, records)
        .withColumn("review_date", times.parse_ts_utc(e["at"]))
        .withColumn("rejected", F.coalesce("fault", F.when(F.col("review_date").isNull(), NO_DATE)))
    )
    body = tt.strip(e["content"])
    return _landed(
        rows.select(
            fallback_id(e["reviewId"], "gp_", F.replace(e["at"], F.lit(" "), F.lit("T"))).alias(
                "source_review_id"
            ),
            "brand_code",
            F.lit("google_play").alias("source_code"),
            "review_date",
            F.expr("try_variant_get(e.score, '$', 'int')").alias("rating"),
            F.coalesce(F.nullif(body, F.lit("")), F.lit(tx.EMPTY_BODY_TEXT)).alias("text"),
            F.nullif(e["userName"], F.lit("")).alias("author_handle"),
            F.nullif(e["reviewCreatedVersion"], F.lit("")).alias("app_version"),
            F.nullif(e["replyContent"], F.lit("")).alias("vendor_response"),
            times.parse_ts_utc(e["repliedAt"]).alias("vendor_response_at"),
            *ARRIVAL_COLUMNS,
            "rejected",
        )
    )


PARSERS = {
    "google_play": parse_google_play,
    "app_store": parse_app_store,
    "trustpilot": parse_trustpilot,
}


def app_store_reviews(payloads: DataFrame) -> DataFrame:
    return accepted(parse_app_store(payloads))


def trustpilot_reviews(payloads: DataFrame) -> DataFrame:
    return accepted(parse_trustpilot(payloads))


def google_play_reviews(payloads: DataFrame) -> DataFrame:
    return accepted(parse_google_play(payloads))
