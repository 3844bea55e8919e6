"""From parsed reviews to one landed run: window, cap, union, dedup, stamp."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avisgrid import schemas
from avisgrid.functions import taxonomy as tx
from avisgrid.functions import times
from avisgrid.operators.ranking import cap_groups, first_per_key
from avisgrid.sources.payloads import ARRIVAL_COLUMNS, PARSERS, accepted

NATURAL_KEY = ["source_code", "source_review_id"]


def recent(df: DataFrame, as_of: Column, days: int = tx.WINDOW_DAYS) -> DataFrame:
    """Sliding window by Paris date, first day included."""
    return df.where(times.in_window(F.col("review_date"), as_of, days))


def arrival_order() -> list[Column]:
    return [F.col(c).asc() for c in ARRIVAL_COLUMNS]


def capped(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` reviews per source and brand in order of arrival; 0 keeps all."""
    order = [*arrival_order(), F.col("source_review_id").asc_nulls_last()]
    return cap_groups(df, ["source_code", "brand_code"], order, n, F.col(ARRIVAL_COLUMNS[0]))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources in one frame; columns one of them lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(df: DataFrame, brand_order: list[str]) -> DataFrame:
    """One row per natural key: the first brand, then the first arrival."""
    position = F.coalesce(
        F.array_position(F.array(*[F.lit(b) for b in brand_order]), F.col("brand_code")), F.lit(0)
    )
    brand_rank = F.when(position == 0, len(brand_order) + 1).otherwise(position)
    order = [brand_rank.asc(), F.col("brand_code").asc_nulls_last(), *arrival_order()]
    return first_per_key(df, NATURAL_KEY, order)


def parsed(payloads: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Payloads per source code to entries, the rejected ones with their reason."""
    return {s: PARSERS[s](p) for s, p in payloads.items()}


def land(
    payloads: dict[str, DataFrame],
    as_of: Column,
    brand_order: list[str],
    days: int = tx.WINDOW_DAYS,
    cap: int = 0,
) -> DataFrame:
    """One run: payloads per source code to landed reviews stamped with ``as_of``.

    All reviews of the window are kept; ``cap`` limits them per source and brand, where asked for.
    """
    return land_parsed(parsed(payloads), as_of, brand_order, days, cap)


def land_parsed(
    entries: dict[str, DataFrame],
    as_of: Column,
    brand_order: list[str],
    days: int = tx.WINDOW_DAYS,
    cap: int = 0,
) -> DataFrame:
    """One run from entries that were parsed before."""
    frames = [recent(accepted(df), as_of, days) for df in entries.values()]
    kept = keep_first(capped(union_sources(frames), cap), brand_order)
    stamped = kept.withColumn("collected_at", as_of.cast("timestamp"))
    return stamped.select(*schemas.LANDED.fieldNames())
