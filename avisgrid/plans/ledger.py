"""The ledger of pushed tickets: bucketed by review key, so that it never moves.

A day's tickets go to the ledger's buckets and are held against the keys there; recording them
rewrites the two narrow columns bucket by bucket, again without moving the keys that were there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from avisgrid.sources import tables

COLUMNS = "review_key string, run_id string"
PART = "keys"


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """Keys with the run that pushed them; None before the first."""
    entry = tables.entries(spark, path).get(PART)
    if entry is None:
        return None
    return spark.table(tables.bucketed(spark, entry.folder, COLUMNS, "review_key", int(entry.made_from)))


def pushed_by_others(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Keys pushed by other runs; a repeated run must not meet its own entries."""
    known = read(spark, path)
    if known is None:
        return spark.createDataFrame([], "review_key string")
    return known.where(F.col("run_id") != run_id).select("review_key")


def merged(known: DataFrame, fresh: DataFrame, run_id: str) -> DataFrame:
    """The ledger with the run's keys in place of those it had."""
    new = fresh.select("review_key", F.lit(run_id).alias("new_run"))
    met = known.where(F.col("run_id") != run_id).join(new, "review_key", "full")
    return met.select("review_key", F.coalesce("run_id", "new_run").alias("run_id"))


def record(spark: SparkSession, path: str, fresh: DataFrame, run_id: str, buckets: int | None = None) -> None:
    """Enter the keys that a run pushes, each once; the run's earlier entries go."""
    entry = tables.entries(spark, path).get(PART)
    keys = fresh.select("review_key").where(F.col("review_key").isNotNull()).distinct()
    if entry is None:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = keys.select("review_key", F.lit(run_id).alias("run_id"))
    else:
        buckets = int(entry.made_from)
        rows = merged(read(spark, path), keys, run_id)
    folder = tables.new_folder(path, PART)
    rows.write.insertInto(tables.bucketed(spark, folder, COLUMNS, "review_key", buckets))
    tables.commit(spark, path, {PART: (folder, str(buckets))})
