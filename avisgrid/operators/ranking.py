"""Ranking that scales: newest-per-key, capped groups, dense numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from avisgrid.session import written


SLOT = "_slot"
BINS = 1024  # of a group's stretch of places in one round
STRETCH_ROWS = 100_000  # rows of a group that are ranked in one task


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (which must be a total order in a key).

    Spark plans a rank limit on both sides of the shuffle: every map task keeps one row
    per key, so a key holding a third of the table costs no more than any other.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def _same_group(keys: list[str], side: str) -> Column:
    """Keys of the rows and of the cuts (prefix ``side``); NULL is a group too."""
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{side}{k}")) for k in keys])


def _cuts(places: DataFrame, keys: list[str], n: int, rows: int) -> DataFrame:
    """For each group the stretch of places that holds its n-th row, and the rows before that stretch.

    Each round counts the rows of ``BINS`` even bins of the stretch and keeps the bin with the n-th row,
    until every stretch has at most ``rows`` rows or one place. A round shuffles counts only.
    """
    named = [F.col(k).alias(f"_{k}") for k in keys]
    cuts = written(
        places.groupBy(*keys).agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.count("*").alias("inside"))
        .select(*named, "lo", "hi", F.lit(0).cast("bigint").alias("before"), "inside"),
        "cuts",
    )
    group = [f"_{k}" for k in keys]
    open_ = (F.col("inside") > rows) & (F.col("hi") > F.col("lo")) & (F.col("before") + F.col("inside") > n)
    while not cuts.where(open_).isEmpty():
        # Even bins; the difference of two longs may not fit one.
        width = F.ceil((F.col("hi").cast("decimal(20,0)") - F.col("lo") + 1) / BINS)
        met = places.join(cuts.where(open_), _same_group(keys, "_")).where("_at BETWEEN lo AND hi")
        bin_ = F.floor((F.col("_at").cast("decimal(20,0)") - F.col("lo")) / width).cast("bigint")
        counts = met.groupBy(*group, "lo", "hi", "before", bin_.alias("bin")).agg(
            F.count("*").alias("held"), F.min("_at").alias("first"), F.max("_at").alias("last")
        )
        up_to = F.sum("held").over(Window.partitionBy(*group).orderBy("bin"))
        counts = counts.withColumn("earlier", F.col("before") + up_to - F.col("held"))
        found = counts.where((F.col("earlier") < n) & (F.col("earlier") + F.col("held") >= n))
        found = found.select(
            *group, F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("earlier").alias("before"),
            F.col("held").alias("inside"),
        )
        cuts = written(cuts.where(~open_).unionByName(found), "cuts")
    return cuts


def cap_groups(
    df: DataFrame, keys: list[str], order: list[Column], n: int, place: Column, rows: int = STRETCH_ROWS
) -> DataFrame:
    """First ``n`` rows of every group; 0 switches the cap off.

    ``place`` is a whole number that never falls along ``order``. Groups are few and large, so their n-th
    row is found by histograms of places first: rows before its stretch stay, rows behind go, and only the
    stretch itself is ranked, ``rows`` rows of a group (or those of one place) whatever ``n`` and the group's size. Exact.
    """
    if n == 0:
        return df
    placed = written(df.withColumn("_at", place.cast("bigint")), "uncut")
    cuts = _cuts(placed.select(*keys, "_at"), keys, n, rows)
    met = placed.join(cuts, _same_group(keys, "_"))
    columns = [F.col(c) for c in df.columns]
    whole = (F.col("_at") < F.col("lo")) | (F.col("before") + F.col("inside") <= n)
    inside = met.where(~whole & (F.col("_at") <= F.col("hi")))
    ranked = inside.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col("before") + F.col("_rank") <= n)
    return met.where(whole & (F.col("_at") <= F.col("hi"))).select(*columns).unionByName(kept.select(*columns))


def slotted(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in global ``order``: range partitions, sorted inside, with their slot.

    The slot is the partition and the row in it.  It must be written before it is used
    (see ``numbered``).  ``order`` must be a total order, so that a retried task gives
    its rows the same slots.
    """
    return (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(SLOT, F.monotonically_increasing_id())
    )


def numbered(stored: DataFrame, name: str = "id") -> DataFrame:
    """Slots of a written table as numbers 1..n.

    The rows of the partitions before give each partition its offset.  Counting them
    reads one column, and the broadcast offsets have one row per partition, whatever the
    size of the data.
    """
    placed = stored.withColumns(
        {
            "_part": F.shiftrightunsigned(SLOT, 33),
            "_row": F.col(SLOT).bitwiseAND((1 << 33) - 1),
        }
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    number = (F.col("_offset") + F.col("_row") + 1).alias(name)
    columns = [c for c in stored.columns if c != SLOT]
    return placed.join(F.broadcast(offsets), "_part").select(number, *columns)


def dense_id(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """Number all rows 1..n in ``order`` without gathering them in one task."""
    return numbered(written(slotted(df, order), "numbered"), name)


def renumber(df: DataFrame, dense: str, name: str, block: int = 1 << 20) -> DataFrame:
    """Number a subset of densely numbered rows 1..n, keeping their order.

    Blocks of ``block`` consecutive numbers. In a block without gaps a row's number is the block's
    offset plus its distance from the first one, so its rows stay where they are; only blocks with gaps
    are shuffled and ranked, at most ``block`` rows each.
    """
    blocks = df.withColumn("_block", F.floor(F.col(dense) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy("_block").agg(
        F.count("*").alias("_n"), F.min(dense).alias("_first"), F.max(dense).alias("_last")
    )
    offsets = counts.select(
        "_block",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).alias("_offset"),
        "_first",
        (F.col("_last") - F.col("_first") + 1 == F.col("_n")).alias("_whole"),
    )
    met = blocks.join(offsets, "_block")
    inside = Window.partitionBy("_block").orderBy(dense)
    gaps = met.where(~F.col("_whole")).withColumn("_place", F.row_number().over(inside) - 1)
    whole = met.where("_whole").withColumn("_place", F.col(dense) - F.col("_first"))
    both = whole.unionByName(gaps)
    return both.select((F.col("_offset") + F.col("_place")).cast("bigint").alias(name), *df.columns)
