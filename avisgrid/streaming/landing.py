"""Incremental landing: payload files that arrived since the last call become one run.

The file source remembers in its checkpoint which files it has read, so a daily call
reads new pages only, and a call repeated after a failure writes the same run again.
A batch replaces a run of its number only if it holds all of that run's reviews. Another feed's batch, or that of a
stream whose checkpoint was lost, becomes a run of its own, named after its checkpoint.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from avisgrid.functions import taxonomy as tx
from avisgrid.operators import landing
from avisgrid.session import prepare, written
from avisgrid.sources import reference_data, tables


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """Pages laid out as ``source_code=<s>/brand_code=<b>/arrival_page=<n>/<file>``."""
    schema = "value string, source_code string, brand_code string, arrival_page bigint"
    return (
        spark.readStream.schema(schema)
        .text(path, wholetext=True)
        .withColumnRenamed("value", "payload")
    )


def _run_id(run: DataFrame, bronze: str, batch_id: int, checkpoint: str) -> str:
    """The first name that is free or whose run holds nothing that this one has not."""
    spark = run.sparkSession
    plain = f"batch-{batch_id:06d}"
    feed = f"{plain}-{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}"
    there = tables.runs(spark, bronze)
    content = [c for c in run.columns if c != "collected_at"]
    for name in itertools.chain((plain, feed), (f"{feed}-{n}" for n in itertools.count(2))):
        if name not in there:
            return name
        stored = tables.read_run(spark, bronze, name).select(*content)
        if stored.subtract(run.select(*content)).isEmpty():
            return name


def land_new_files(
    spark: SparkSession,
    path: str,
    bronze: str,
    checkpoint: str,
    as_of: Column,
    days: int = tx.WINDOW_DAYS,
    cap: int = 0,
) -> list[str]:
    """Land everything new below ``path`` and stop; returns the ids of the runs written.

    The run id comes from the batch, so a batch repeated on a later day replaces its own
    run; where a run of another stream must stay, a hash of the checkpoint's path follows. A page of an unknown source stops the landing before anything is marked as read.
    """
    prepare(spark)
    brands = [r.code for r in reference_data.seed(spark, "brands").orderBy("id").collect()]
    done: list[str] = []

    def land(batch: DataFrame, batch_id: int) -> None:
        stored = written(batch, "pages")  # each file is read once, whatever the sources
        known = list(landing.PARSERS)
        strange = stored.where(~F.coalesce(F.col("source_code").isin(known), F.lit(False)))
        names = [r[0] for r in strange.select("source_code").distinct().take(5)]
        if names:
            raise ValueError(f"pages of unknown sources: {names}")
        pages = {s: stored.where(F.col("source_code") == s).drop("source_code") for s in known}
        run = landing.land(pages, as_of, brands, days, cap)
        run_id = _run_id(run, bronze, batch_id, checkpoint)
        tables.write_run(run, bronze, run_id)
        done.append(run_id)

    query = (
        payload_stream(spark, path)
        .writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return done
