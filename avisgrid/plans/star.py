"""Staging, key resolution, dimensions and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from avisgrid import schemas
from avisgrid.functions import taxonomy as tx
from avisgrid.functions import times
from avisgrid.operators.ranking import dense_id, first_per_key, numbered, renumber, slotted
from avisgrid.session import written

CALENDAR = ("2024-01-01", "2026-12-31")
OPEN_STATUS = 1


def newest_first() -> list[Column]:
    """Newest copy first; the columns after ``collected_at`` only settle ties.

    The text is no tie-breaker: marts that do not show it need not read or shuffle it.
    A run holds a key once, so the run id, which ``staged`` adds, settles what is left.
    """
    return [
        *[F.col(c).desc_nulls_first() for c in ("collected_at", "classified_at", "review_date")],
        *[F.col(c).asc_nulls_last() for c in ("brand_code", "rating", "category_code")],
    ]


def staged(raw: DataFrame) -> DataFrame:
    """Latest version per natural key, with response latency and flag."""
    return newest_versions(raw).drop("run_id")


def newest_versions(raw: DataFrame) -> DataFrame:
    """``staged`` with the run that each version came with, where ``raw`` has it."""
    latency = F.date_diff(F.to_date("vendor_response_at"), F.to_date("review_date"))
    order = newest_first()
    if "run_id" in raw.columns:
        order.append(F.col("run_id").desc_nulls_last())
    newest = first_per_key(raw, ["source_code", "source_review_id"], order)
    return newest.withColumns(
        {
            "rating": F.col("rating").cast("int"),
            "response_latency_days": latency,
            "vendor_responded": F.col("vendor_response").isNotNull(),
        }
    )


def review_key() -> Column:
    """Stable key of a review, the same in every run."""
    missing = F.lit("\x1e")  # keeps NULL apart from the empty string
    parts = [F.coalesce(c, missing) for c in ("source_code", "source_review_id")]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def with_keys(stage: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    """Resolve codes to ids; an unknown code gives a NULL id and keeps the row."""
    out = stage
    for table, code, key in (
        ("brands", "brand_code", "brand_id"),
        ("sources", "source_code", "source_id"),
        ("categories", "category_code", "category_id"),
        ("personas", "persona_code", "persona_id"),
        ("severities", "severity_code", "severity_id"),
    ):
        dim = seeds[table].select(F.col("id").alias(key), F.col("code").alias(code))
        out = out.join(dim, code, "left")
    return out.withColumns({"review_key": review_key(), "date_id": times.date_id(F.col("review_date"))})


def classified_reviews(raw: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    """Deduplicated reviews with their classification and ids, one row per natural key.

    Reviews and classifications are 1:1, so every mart starts from this one frame and
    no job joins the two facts again.
    """
    return with_keys(staged(raw), seeds)


def calendar(spark: SparkSession, first: str = CALENDAR[0], last: str = CALENDAR[1]) -> DataFrame:
    """One row per day with the usual calendar parts (ISO week, Sunday = 0)."""
    days = spark.range(1).select(
        F.explode(
            F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 DAY"))
        ).alias("date")
    )
    weekday = F.dayofweek("date") - 1
    return days.select(
        F.date_format("date", "yyyyMMdd").cast("int").alias("date_id"),
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.weekofyear("date").alias("week"),
        weekday.alias("day_of_week"),
        weekday.isin(0, 6).alias("is_weekend"),
    )


DIMENSIONS = {
    "dim_brand": "brands",
    "dim_source": "sources",
    "dim_category": "categories",
    "dim_severity": "severities",
    "dim_persona": "personas",
    "dim_ticket_status": "ticket_statuses",
}


def dimension(seeds: dict[str, DataFrame], name: str) -> DataFrame:
    table = DIMENSIONS[name]
    return seeds[table].select(*schemas.SEEDS[table].fieldNames())


def dated_order() -> list[Column]:
    """Total order of the review numbering."""
    return [
        F.col(c).asc_nulls_last() for c in ("review_date", "source_review_id", "source_code")
    ]


def dated_reviews(classified: DataFrame) -> DataFrame:
    """Classified reviews in the order of their numbers, to be written once.

    No fact holds the text of the vendor's response, so it stays out of the sort.
    """
    return slotted(classified.drop("vendor_response"), dated_order())


def numbered_reviews(classified: DataFrame) -> DataFrame:
    """Classified reviews with the dense ``id`` by date, read by all facts."""
    return numbered(written(dated_reviews(classified), "reviews"))


def fact_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("language", F.lit("fr")).select(*schemas.FACT_REVIEWS)


def in_classifications(df: DataFrame) -> DataFrame:
    """Rows that have a classification: both parts of the key must be known."""
    return df.where("source_id IS NOT NULL AND source_review_id IS NOT NULL")


def fact_classifications(reviews: DataFrame) -> DataFrame:
    rows = in_classifications(reviews).select(
        F.col("id").alias("review_id"),
        "review_key",
        "category_id",
        "severity_id",
        "severity_rating_score",
        "severity_text_score",
        F.lit(1.0).alias("confidence"),
        F.coalesce("category_source", F.lit(tx.SOURCE_KEYWORDS)).alias("method"),
        "classified_at",
    )
    return renumber(rows, "review_id", "id").select(*schemas.FACT_CLASSIFICATIONS)


def high_severity() -> Column:
    return (F.col("severity_code") == "high") & F.col("severity_id").isNotNull()


def critical_categories(seeds: dict[str, DataFrame]) -> DataFrame:
    return seeds["categories"].where("is_critical").select(F.col("id").alias("category_id"))


def critical_reviews(df: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    """Usable reviews of high severity in a critical category: one ticket each."""
    rows = in_classifications(df).where(F.col("is_exploitable") & high_severity())
    return rows.join(critical_categories(seeds), "category_id", "left_semi")


def numbered_tickets(reviews: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    """Open tickets with the review columns their marts need.

    Numbered newest collection first; the review id settles ties.
    """
    rows = critical_reviews(reviews, seeds).select(
        F.col("id").alias("review_id"),
        "review_key",
        F.lit(None).cast("string").alias("external_ticket_id"),
        F.lit(OPEN_STATUS).alias("status_id"),
        "severity_id",
        F.lit("csv").alias("channel"),
        F.lit(None).cast("string").alias("assignee"),
        F.col("collected_at").alias("created_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolution_notes"),
        "category_id",
        "brand_id",
        "source_id",
        F.substring("text", 1, tx.EXCERPT_CHARS).alias("excerpt"),
        "vendor_responded",
    )
    return dense_id(rows, [F.col("created_at").desc_nulls_first(), F.col("review_id").asc()])


def fact_tickets(ticket_rows: DataFrame) -> DataFrame:
    return ticket_rows.select(*schemas.FACT_TICKETS)
