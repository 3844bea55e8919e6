"""Feistel sharding: a keyed permutation of global row numbers gives shard and slot.

Rows are numbered by id, then text checksum and size. The Feistel network permutes
[0, a*b), the smallest near-square that holds all rows; numbers that land beyond the last
row are walked on along their cycle. Shard is the permuted number modulo the shard count,
slot the quotient: counts differ by one at most, and both are computable from the row
number alone (``locate``).

Null text has no bytes (size 1, checksum 0). A null id sorts first. Repeated rows get
numbers of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from avisgrid.llm.common import checkpointed

SEED = 20240210
ROUNDS = 6
SHARDS = 8


def domain(n_rows: int) -> tuple[int, int]:
    """Sides of the smallest near-square with at least ``n_rows`` cells."""
    a = max(1, math.isqrt(max(n_rows - 1, 0)) + 1)
    return a, max(1, -(-n_rows // a))


def permuted(value: Column, n_rows: int, seed: int = SEED, walks: int = 0) -> Column:
    """The network applied once, then up to ``walks`` times more while beyond the rows.

    Rounds are a fold over their numbers, so the expression stays small however often an
    optimizer copies it.
    """
    a, b = domain(n_rows)

    def turn(state: Column, r: Column) -> Column:
        left, right = state["l"], state["r"]
        key = r.cast("long") + F.lit(seed).cast("long")
        new_left = F.pmod(left + F.pmod(F.xxhash64(key, right), F.lit(a)), F.lit(a))
        new_right = F.pmod(right + F.pmod(F.xxhash64(key, left), F.lit(b)), F.lit(b))
        even = r % 2 == 0
        return F.struct(
            F.when(even, new_left).otherwise(left).alias("l"),
            F.when(even, right).otherwise(new_right).alias("r"),
        )

    def once(v: Column) -> Column:
        start = F.struct(F.call_function("div", v, F.lit(b).cast("long")).alias("l"), (v % F.lit(b).cast("long")).alias("r"))
        rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(rounds, start, turn, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(walks)),
        value.cast("long"),
        lambda v, i: F.when((i == 0) | (v >= n_rows), once(v)).otherwise(v),
    )


def longest_walk(spark: SparkSession, n_rows: int, seed: int = SEED) -> int:
    """Passes after which every row's number is back among the rows.

    Numbers beyond the rows are fewer than the square root of the rows. Some may lie on
    cycles of their own, which no row enters: the walks start where rows land.
    """
    a, b = domain(n_rows)
    beyond = spark.range(n_rows, a * b).toDF("p")
    inner = beyond.select(permuted(F.col("p"), n_rows, seed).alias("p"))
    beyond, steps = beyond.join(inner, "p", "left_anti"), 0
    while not beyond.isEmpty():
        steps += 1
        beyond = checkpointed(
            beyond.select(permuted(F.col("p"), n_rows, seed).alias("p")).filter(F.col("p") >= n_rows)
        )
    return steps


def _mixed(key: int, half: int) -> int:
    """Spark's xxhash64 of two longs."""
    value = 42
    for part in (key, half):
        value = xxhash.xxh64_intdigest(part.to_bytes(8, "little", signed=True), value)
    return value - (1 << 64) if value >= 1 << 63 else value


def locate(row: int, n_rows: int, n_shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number, without any table."""
    a, b = domain(n_rows)
    while True:
        left, right = divmod(row, b)
        for r in range(ROUNDS):
            if r % 2 == 0:
                left = (left + _mixed(seed + r, right)) % a
            else:
                right = (right + _mixed(seed + r, left)) % b
        row = left * b + right
        if row < n_rows:
            return row % n_shards, row // n_shards


def row_numbers(df: DataFrame, *order: str, out: str = "row") -> tuple[DataFrame, int]:
    """Number narrow rows from 0 in a total order; returns the frame and the row count.

    Range partitions are sorted and kept in a checkpoint, so that a lost executor cannot
    move a boundary between counting and numbering. A row's place in its scan splits equal
    rows over partitions; they are interchangeable.
    """
    ranged = checkpointed(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .withColumns(
            {
                "_part": F.spark_partition_id(),
                "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
        .drop("_tie")
    )
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    # One row per partition, so the broadcast is bounded by the partition count.
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = ranged.join(F.broadcast(starts), "_part")
    total = ranged.count()
    return numbered.withColumn(out, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), total


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of every document under the law ``rows``; texts never move."""
    data = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
    )
    rows, n_rows = row_numbers(narrow, "doc_id", "text_crc32", "size", out="row")
    walks = longest_walk(docs.sparkSession, n_rows, seed)
    placed = rows.withColumn("place", permuted(F.col("row"), n_rows, seed, walks))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.expr(f"place div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )
