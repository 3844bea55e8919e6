"""Committed tables, bronze runs, the raw table and CSV exports."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from avisgrid import schemas


# Quotes are doubled inside quotes and blanks kept, as every CSV reader expects.
CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


class NoRunError(FileNotFoundError):
    """There is no bronze run to read."""


class NoTableError(FileNotFoundError):
    """Nothing was ever committed to a table."""


# A table is a log of commits beside folders of data that are never changed. Each entry names the
# folder that holds a part from then on (none: the part is empty) and what it was made from.
ENTRY = "seq bigint, part string, folder string, made_from string"


def entries(spark: SparkSession, path: str) -> dict[str, Row]:
    """The newest entry of every part; one row for each run or month."""
    try:
        log = spark.read.schema(ENTRY).json(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    newest = log.groupBy("part").agg(F.max(F.struct("seq", "folder", "made_from")).alias("newest"))
    return {r.part: r.newest for r in newest.collect()}


def commit(
    spark: SparkSession,
    path: str,
    changes: dict[str, tuple[str | None, str | None]],
    known: dict[str, Row] | None = None,
) -> None:
    """Put folders in the place of parts, all at once: one file that appears complete or not at all.

    A reader sees the parts before or after, never between. One writer at a time.
    """
    known = entries(spark, path) if known is None else known
    seq = 1 + max((e.seq for e in known.values()), default=0)
    rows = [(seq, part, folder, made_from) for part, (folder, made_from) in changes.items()]
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").json(f"{path}/log")


def new_folder(path: str, part: str = "") -> str:
    return f"{path}/data/{part or 'all'}/{uuid.uuid4().hex}"


def put(df: DataFrame, path: str, part: str = "", made_from: str | None = None) -> str:
    """Write a part and commit it; until then readers see the one before. Returns its folder."""
    folder = new_folder(path, part)
    df.write.parquet(folder)
    commit(df.sparkSession, path, {part: (folder, made_from)})
    return folder


def read(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    parts: list[str] | None = None,
    known: dict[str, Row] | None = None,
) -> DataFrame:
    """All parts of a table, or those named; only their folders are listed and read.

    ``known`` saves reading the log once more.
    """
    known = entries(spark, path) if known is None else known
    if not known and schema is None:
        raise NoTableError(f"no table at {path}")
    folders = [e.folder for p, e in sorted(known.items()) if e.folder and (parts is None or p in parts)]
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*folders)


def bucketed(spark: SparkSession, folder: str, columns: str, key: str, buckets: int) -> str:
    """A name under which a folder is known with its buckets, for reading and for ``insertInto``.

    Joins and aggregates on the key need no exchange of such a table.
    """
    name = "bucketed_" + folder.rsplit("/", 1)[1]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    return name


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders that no part needs any more; returns how many. Readers of old parts must be done."""
    kept = {e.folder for e in entries(spark, path).values()}
    log = spark.read.schema(ENTRY).json(f"{path}/log").where(F.col("folder").isNotNull())
    old = [r.folder for r in log.select("folder").distinct().collect() if r.folder not in kept]
    for folder in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    return len(old)


def export(df: DataFrame, path: str, kind: str, **options) -> None:
    """Write files for readers outside of Spark, at a fixed path.

    The old files stay until the new ones are complete, and come back if those cannot take their
    place. Names with an underscore are invisible to Spark's readers.
    """
    spark = df.sparkSession
    parent, own = path.rstrip("/").rsplit("/", 1)
    fresh, old = (f"{parent}/_{part}-{uuid.uuid4().hex}" for part in ("new", "old"))
    df.write.format(kind).options(**options).save(fresh)
    at, fresh, old = map(spark._jvm.org.apache.hadoop.fs.Path, (f"{parent}/{own}", fresh, old))
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = fs.exists(at)
    if there and not fs.rename(at, old):
        raise OSError(f"cannot move the old files from {path}")
    if not fs.rename(fresh, at):
        if there and not fs.rename(old, at):
            raise OSError(f"cannot move the new files to {path}; the old ones are in {old.toString()}")
        raise OSError(f"cannot move the new files to {path}")
    if there:
        fs.delete(old, True)


def write_run(df: DataFrame, bronze: str, run_id: str) -> str:
    """Write one run as a part of its own; an empty run keeps its schema. Returns its folder."""
    return put(df, bronze, f"run_id={run_id}")


def runs(spark: SparkSession, path: str) -> dict[str, Row]:
    """The newest entry of every run, in the order of their ids."""
    return {p.split("=", 1)[1]: e for p, e in sorted(entries(spark, path).items()) if p.startswith("run_id=")}


def run_ids(spark: SparkSession, bronze: str) -> list[str]:
    return list(runs(spark, bronze))


def read_run(spark: SparkSession, bronze: str, run_id: str | None = None) -> DataFrame:
    """A run, by default the last one by name; only its own files are listed and read."""
    known = runs(spark, bronze)
    if not known or (run_id is not None and run_id not in known):
        raise NoRunError(f"no run {run_id or ''} below {bronze}")
    return spark.read.schema(schemas.LANDED).parquet(known[run_id or list(known)[-1]].folder)


def null_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating point column."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def raw_columns(df: DataFrame) -> DataFrame:
    """The raw contract: known columns in order and type, missing ones as NULL."""
    present = set(df.columns)
    return null_missing(df).selectExpr(
        *[
            f"CAST({f.name if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in schemas.RAW.fields
        ]
    )


def write_raw(df: DataFrame, path: str) -> int:
    """Replace the raw table and return its row count; an empty batch changes nothing."""
    if df.isEmpty():
        return 0
    folder = put(raw_columns(df), path)
    return df.sparkSession.read.schema(schemas.RAW).parquet(folder).count()


def load_raw_run(df: DataFrame, path: str, run_id: str, made_from: str) -> int:
    """Put a refined run into the raw table's part of that run; returns its rows.

    The entry keeps the bronze folder it was made from. A run without rows takes its old rows away and counts as loaded.
    """
    part = f"run_id={run_id}"
    folder = new_folder(path, part)
    df.withColumn("run_id", F.lit(run_id)).write.parquet(folder)
    rows = df.sparkSession.read.schema(schemas.RAW_RUNS).parquet(folder).count()
    commit(df.sparkSession, path, {part: (folder if rows else None, made_from)})
    return rows


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with header, also for a frame without rows."""
    export(df, path, "csv", **CSV)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An exported file, line breaks inside quotes included."""
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)
