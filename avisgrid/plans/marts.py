"""The four business marts and ad-hoc counts over them.

Marts aggregate the 1:1 classified reviews once, on few keys, so the shuffle carries
partial sums only.  Comparisons between brands are windows over these small cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from avisgrid.functions import taxonomy as tx
from avisgrid.plans.star import OPEN_STATUS, critical_categories, high_severity, in_classifications

WHOLE = "decimal(20,0)"


def ratio(part: Column, whole: Column) -> Column:
    """Exact decimal quotient, NULL for an empty whole."""
    return F.when(whole != 0, part.cast(WHOLE) / whole.cast(WHOLE))


def rounded(value: Column, digits: int) -> Column:
    """Round a decimal half away from zero, then hand it out as a double."""
    return F.round(value, digits).cast("double")


def usable(classified: DataFrame) -> DataFrame:
    """Rows of the business marts: usable, classified, with a known severity."""
    return in_classifications(classified).where(
        F.col("is_exploitable") & F.col("severity_id").isNotNull()
    )


def with_ticket_status(
    classified: DataFrame, seeds: dict[str, DataFrame], statuses: DataFrame | None = None
) -> DataFrame:
    """Flag ticket rows and whether their ticket is closed.

    ``statuses`` (``review_key, status_id``) overrides the initial open status.
    """
    critical = critical_categories(seeds).withColumn("_critical", F.lit(True))
    out = classified.join(critical, "category_id", "left").withColumn(
        "is_ticket", F.col("_critical").isNotNull() & high_severity()
    )
    status_id = F.lit(OPEN_STATUS)
    if statuses is not None:
        known = statuses.select("review_key", F.col("status_id").alias("_known"))
        out = out.join(known, "review_key", "left")
        status_id = F.coalesce("_known", status_id)
    # Only ticket rows carry a status, so the lookup stays an equi-join.
    out = out.withColumn("_status_id", F.when(F.col("is_ticket"), status_id))
    status = seeds["ticket_statuses"].select(
        F.col("id").alias("_status_id"), F.col("is_terminal").alias("_terminal")
    )
    return out.join(status, "_status_id", "left").withColumns(
        {
            "is_ticket": F.col("is_ticket") & F.col("_terminal").isNotNull(),
            "is_closed": F.col("is_ticket") & F.coalesce("_terminal", F.lit(False)),
        }
    )


def daily_cells(
    classified: DataFrame, seeds: dict[str, DataFrame], statuses: DataFrame | None = None
) -> DataFrame:
    """Sums per date and brand: the only pass over the reviews for the synthesis."""
    rows = with_ticket_status(usable(classified), seeds, statuses)
    return rows.groupBy("date_id", "brand_id").agg(
        F.count("*").alias("total_reviews"),
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("rating_count"),
        F.count_if(high_severity()).alias("high_count"),
        F.count_if("is_ticket").alias("ticket_count"),
        F.count_if("is_closed").alias("closed_count"),
    )


def per_day_brand(cells: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    """Volume, mean rating and share of high severity per date and brand."""
    brand = seeds["brands"].select(
        F.col("id").alias("brand_id"),
        F.col("code").alias("brand_code"),
        F.col("label").alias("brand_label"),
        "is_focus",
    )
    return cells.join(brand, "brand_id").select(
        "date_id",
        "brand_id",
        "brand_code",
        "brand_label",
        "is_focus",
        "total_reviews",
        ratio(F.col("rating_sum"), F.col("rating_count")).alias("avg_rating"),
        ratio(F.col("high_count"), F.col("total_reviews")).alias("share_critical"),
    )


def competitor_avg(daily: DataFrame) -> DataFrame:
    """Unweighted mean of the daily means of all brands but the focus brand."""
    return (
        daily.where(~F.col("is_focus"))
        .groupBy("date_id")
        .agg(F.avg("avg_rating").alias("competitor_avg_rating"))
    )


def ticket_resolution(cells: DataFrame) -> DataFrame:
    """Share of closed tickets per date, over all brands."""
    tickets = F.sum("ticket_count")
    return (
        cells.groupBy("date_id")
        .agg(
            tickets.alias("tickets_open"),
            ratio(F.sum("closed_count"), tickets).alias("resolution_rate"),
        )
        .where("tickets_open > 0")
    )


def direction_synthesis(
    classified: DataFrame, seeds: dict[str, DataFrame], statuses: DataFrame | None = None
) -> DataFrame:
    """Five indicators per date and brand, in one pass over the reviews."""
    return synthesis_of(daily_cells(classified, seeds, statuses), seeds)


def synthesis_of(cells: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    """The five indicators from daily cells.

    Competitor mean and resolution rate are windows over the cells, so the
    reviews are scanned and shuffled once instead of three times.
    """
    brand = seeds["brands"].select(
        F.col("id").alias("brand_id"), F.col("label").alias("brand_label"), "is_focus"
    )
    day = Window.partitionBy("date_id")
    rival_mean = F.when(F.col("is_focus") == False, F.col("avg_exact"))  # noqa: E712
    known_day = F.col("date_id").isNotNull()
    daily = (
        cells.join(brand, "brand_id", "left")
        .withColumn("avg_exact", ratio(F.col("rating_sum"), F.col("rating_count")))
        .withColumns(
            {
                "competitors": F.when(known_day, F.avg(rival_mean).over(day)),
                "rate": F.when(
                    known_day,
                    ratio(F.sum("closed_count").over(day), F.sum("ticket_count").over(day)),
                ),
            }
        )
        .where(F.col("brand_label").isNotNull())
    )
    gap = F.col("avg_exact") - F.col("competitors")
    return daily.select(
        "date_id",
        "brand_label",
        "total_reviews",
        rounded(F.col("avg_exact"), 2).alias("avg_rating"),
        rounded(ratio(F.col("high_count"), F.col("total_reviews")), 3).alias("share_critical"),
        F.coalesce(F.col("rate").cast("double"), F.lit(0.0)).alias("ticket_resolution_rate"),
        F.when(F.col("is_focus"), rounded(gap, 2)).alias("gap_vs_competitors"),
    )


def marketing_cells(classified: DataFrame) -> DataFrame:
    """Sums per date, brand, category and persona."""
    return (
        usable(classified)
        .groupBy("date_id", "brand_id", "category_id", "persona_id")
        .agg(
            F.count("*").alias("review_count"),
            F.sum("rating").alias("rating_sum"),
            F.count("rating").alias("rating_count"),
            F.count_if(high_severity()).alias("high_count"),
        )
    )


def focus_baseline(cells: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    """Mean cell volume of the focus brand per category."""
    focus = seeds["brands"].where("is_focus").select(F.col("id").alias("brand_id"))
    return (
        cells.join(focus, "brand_id", "left_semi")
        .groupBy("category_id")
        .agg(ratio(F.sum("review_count"), F.count("*")).alias("focus_volume"))
    )


def marketing_voice(classified: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    """Volume, rating and severity per cell, with the volume relative to the focus brand."""
    return voice_of(marketing_cells(classified), seeds)


def voice_of(cells: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    """The marketing mart from its cells."""
    brand = seeds["brands"].select(
        F.col("id").alias("brand_id"), F.col("label").alias("brand_label"), "is_focus"
    )
    category = seeds["categories"].select(
        F.col("id").alias("category_id"), F.col("label").alias("category_label")
    )
    persona = seeds["personas"].select(
        F.col("id").alias("persona_id"), F.col("label").alias("persona_label")
    )
    per_category = Window.partitionBy("category_id")
    focus_cell = F.when(F.col("is_focus"), F.col("review_count"))
    labelled = (
        cells.join(brand, "brand_id")
        .withColumn("focus_sum", F.sum(focus_cell).over(per_category))
        .withColumn("focus_cells", F.count(focus_cell).over(per_category))
        .join(category, "category_id")
        .join(persona, "persona_id")
    )
    # review_count / (focus_sum / focus_cells) without an inexact intermediate.
    relative = ratio(F.col("review_count") * F.col("focus_cells"), F.col("focus_sum"))
    return labelled.select(
        "date_id",
        "brand_label",
        "category_label",
        "persona_label",
        "review_count",
        rounded(ratio(F.col("rating_sum"), F.col("rating_count")), 2).alias("avg_rating"),
        rounded(ratio(F.col("high_count"), F.col("review_count")), 3).alias("share_high_severity"),
        F.when(F.col("focus_sum") > 0, rounded(relative, 2)).alias("ratio_vs_abritel"),
    )


def _labels(seeds: dict[str, DataFrame], table: str, key: str, label: str) -> DataFrame:
    return seeds[table].select(F.col("id").alias(key), F.col("label").alias(label))


def finance_disputes(numbered: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    """Usable reviews about money or payment, with the vendor's response."""
    disputed = seeds["categories"].where(F.col("code").isin(*tx.DISPUTE_CATEGORIES))
    category = disputed.select(
        F.col("id").alias("category_id"),
        F.col("code").alias("dispute_code"),
        F.col("label").alias("category_label"),
    )
    rows = in_classifications(numbered).where("is_exploitable")
    return (
        rows.join(category, "category_id")
        .join(_labels(seeds, "severities", "severity_id", "severity_label"), "severity_id")
        .join(_labels(seeds, "brands", "brand_id", "brand_label"), "brand_id")
        .join(_labels(seeds, "sources", "source_id", "source_label"), "source_id")
        .select(
            F.col("id").alias("review_id"),
            "review_key",
            "date_id",
            "brand_label",
            "source_label",
            F.col("dispute_code").alias("category_code"),
            "category_label",
            "severity_label",
            "rating",
            "vendor_responded",
            "response_latency_days",
            F.substring("text", 1, tx.EXCERPT_CHARS).alias("review_excerpt"),
            "review_date",
        )
    )


def support_tickets(
    ticket_rows: DataFrame, seeds: dict[str, DataFrame], as_of: Column
) -> DataFrame:
    """One row per ticket with its review and the whole days it has been open.

    ``ticket_rows`` (see ``star.numbered_tickets``) already carries the review columns,
    so tickets are not joined back to the reviews.
    """
    open_for = F.extract(F.lit("DAY"), as_of - F.col("created_at"))
    return (
        ticket_rows.join(_labels(seeds, "categories", "category_id", "category_label"), "category_id")
        .join(_labels(seeds, "severities", "severity_id", "severity_label"), "severity_id")
        .join(_labels(seeds, "ticket_statuses", "status_id", "status_label"), "status_id")
        .join(_labels(seeds, "brands", "brand_id", "brand_label"), "brand_id")
        .join(_labels(seeds, "sources", "source_id", "source_label"), "source_id")
        .select(
            F.col("id").alias("ticket_id"),
            "review_id",
            "review_key",
            "category_label",
            "severity_label",
            "status_label",
            "assignee",
            open_for.cast("int").alias("days_open"),
            F.col("excerpt").alias("review_excerpt"),
            "vendor_responded",
            "brand_label",
            "source_label",
            "created_at",
        )
    )


def mart_counts(mart: DataFrame, by: str = "brand_label") -> DataFrame:
    """Rows of a mart per label."""
    return mart.groupBy(by).agg(F.count("*").alias("n_rows"))
