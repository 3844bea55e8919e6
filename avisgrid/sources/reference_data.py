"""Typed reference tables (brands, sources, categories, severities, personas, statuses)."""

from __future__ import annotations

from functools import cache
from importlib import resources

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession

from avisgrid import schemas

_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


@cache
def _packaged(name: str) -> pa.Table:
    types = {f.name: _ARROW[f.dataType.simpleString()] for f in schemas.SEEDS[name].fields}
    with resources.files("avisgrid.sources").joinpath(f"seeds/{name}.csv").open("rb") as handle:
        return pacsv.read_csv(handle, convert_options=pacsv.ConvertOptions(column_types=types))


@cache
def _packaged_seed(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(_packaged(name), schema=schemas.SEEDS[name])


def seed(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A reference table; ``folder`` names a shared folder with replacement CSV files.

    Packaged tables have one plan per session. Replacement files are listed on every call, so a
    file that was replaced meanwhile is read as it is now.

    No broadcast hint is given: the packaged tables (8 rows at most) become local
    relations of known size and replacement files are sized by the scan, so Spark
    broadcasts them below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond.
    """
    if folder:
        return spark.read.schema(schemas.SEEDS[name]).csv(f"{folder}/{name}.csv", header=True)
    return _packaged_seed(spark, name)


def seeds(spark: SparkSession, folder: str | None = None) -> dict[str, DataFrame]:
    return {name: seed(spark, name, folder) for name in schemas.SEEDS}
