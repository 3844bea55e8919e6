"""Reading, shared intermediate tables and text columns of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from avisgrid.session import work_dir

# Rows of a side that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 100_000


# Arrow batches of texts: a worker holds a few of them at once, whatever the texts' lengths.
ARROW_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound what crosses between executors and their Python workers at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder all executors reach."""
    context = bounded_batches(df.sparkSession).sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast where the counted rows allow it, else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def held_out(doc_id: Column, remainder: int) -> Column:
    """Whether crc32 of the id's text, modulo 5, is ``remainder``; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def n_code_points(text: Column) -> Column:
    return F.char_length(text).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The frame's columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_rows(df: DataFrame, change: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` from the frame's columns to the same columns, whatever their names hold."""
    bounded_batches(df.sparkSession)
    names, inner = df.columns, [f"c{i}" for i in range(len(df.columns))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(inner, df.schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (pa.RecordBatch.from_arrays(b.columns, names) for b in batches)
        for batch in change(named):
            yield pa.RecordBatch.from_arrays(batch.columns, inner)

    return df.toDF(*inner).mapInArrow(renamed, schema).toDF(*names)
