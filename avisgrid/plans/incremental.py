"""The star kept up to date by touched month instead of rebuilt from all history.

One committed store (see ``sources.tables``) holds, as parts:

* ``newest``: the newest version of every review without its text, bucketed by review key. New runs are
  merged into it bucket by bucket, so the history is read but never shuffled.
* ``month=...``: the classified reviews of a month, sorted, with their slots. Only months that a changed
  version leaves or enters are read and written again.
* ``order``: rows for each month and range, an index of order statistics. The dense number of a
  review is the prefix sum of its range plus its place in it, so a new review in an old month renumbers
  everything after it without touching it.
* ``direction=...`` and ``marketing=...``: sums of the two cubes by month. Changed versions change them as
  signed deltas: the superseded version counts minus one, the new one plus one.
* ``run=...``: the raw folder of every run that was merged.

A day's parts are committed together: a failed step leaves all of them as they were, and the next
call makes up for it. A run that was loaded again (or emptied) takes its versions back: its reviews
are chosen anew among all runs. The list of touched months is the only data collected; it is bounded
by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from avisgrid import schemas
from avisgrid.operators.ranking import SLOT, slotted
from avisgrid.plans import marts, star
from avisgrid.session import written
from avisgrid.sources import tables

UNDATED = "none"  # month of reviews without a date, after all others as in the numbering
ROW_BITS = 33  # of a slot; the rest is its range

# How versions of a review are ordered: column, ascending, NULL first. The same order as ``star.newest_first``.
VERSION_ORDER = (
    ("collected_at", False, True),
    ("classified_at", False, True),
    ("review_date", False, True),
    ("brand_code", True, False),
    ("rating", True, False),
    ("category_code", True, False),
    ("run_id", False, False),
)

# What the merge and the cubes need of a version.
VERSION = (
    "collected_at timestamp, classified_at timestamp, review_date timestamp, brand_code string, rating int, "
    "category_code string, run_id string, month string, source_review_id string, source_id int, date_id int, "
    "brand_id int, category_id int, persona_id int, severity_id int, severity_code string, is_exploitable boolean"
)
NAMES = tuple(c.split()[0] for c in VERSION.split(", "))

CUBES = {
    "direction": ("date_id", "brand_id"),
    "marketing": ("date_id", "brand_id", "category_id", "persona_id"),
}
COUNTS = {"direction": "total_reviews", "marketing": "review_count"}


def month_of(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(UNDATED))


def precedes(new: str, old: str) -> Column:
    """Whether one version (a struct) comes before another one in ``VERSION_ORDER``."""
    wins = F.lit(False)
    for name, ascending, null_first in reversed(VERSION_ORDER):
        x, y = F.col(f"{new}.{name}"), F.col(f"{old}.{name}")
        first, second = (x, y) if null_first else (y, x)
        ahead = (first.isNull() & second.isNotNull()) | F.coalesce(x < y if ascending else x > y, F.lit(False))
        behind = (second.isNull() & first.isNotNull()) | F.coalesce(x > y if ascending else x < y, F.lit(False))
        wins = F.when(ahead, True).when(behind, False).otherwise(wins)
    return wins


# --- the newest versions, by bucket -----------------------------------------


def _bucketed(spark: SparkSession, folder: str, buckets: int) -> str:
    return tables.bucketed(spark, folder, f"review_key string, {VERSION}", "review_key", buckets)


def newest(spark: SparkSession, store: str, known: dict[str, Row] | None = None) -> DataFrame | None:
    """The bucketed versions; None before the first merge."""
    entry = (tables.entries(spark, store) if known is None else known).get("newest")
    return spark.table(_bucketed(spark, entry.folder, int(entry.made_from))) if entry else None


def _versions(classified: DataFrame) -> DataFrame:
    named = classified.withColumn("month", month_of(F.col("review_date")))
    return named.select("review_key", F.struct(*NAMES).alias("after"))


def changed_versions(state: DataFrame, arrived: DataFrame, replaced: list[str]) -> DataFrame:
    """``review_key, before, after`` of every review whose newest version is another one now.

    Both sides meet in the state's buckets: only arrivals move. A version that a replaced run brought is void.
    """
    before = state.select("review_key", F.struct(*NAMES).alias("before"))
    met = before.join(arrived, "review_key", "full" if replaced else "right")
    void = F.coalesce(F.col("before.run_id").isin(replaced), F.lit(False)) if replaced else F.lit(False)
    better = F.col("after").isNotNull() & (F.col("before").isNull() | precedes("after", "before"))
    return met.where(void | better)


def merged_versions(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state with the changed versions in their places; its own rows stay in their buckets."""
    before = state.select("review_key", F.struct(*NAMES).alias("kept"))
    met = before.join(changes.select("review_key", F.lit(True).alias("changed"), "after"), "review_key", "full")
    now = F.when(F.col("changed"), F.col("after")).otherwise(F.col("kept"))
    return met.select("review_key", now.alias("now")).where("now IS NOT NULL").select("review_key", "now.*")


# --- months and numbers -----------------------------------------------------


def _by_month(df: DataFrame, folder: str, months: Column) -> dict[str, str]:
    """Write a frame with a folder for each month; returns the folders of months that have rows."""
    df.withColumn("part", months).write.partitionBy("part").parquet(folder)
    found = df.sparkSession.read.parquet(folder).select("part").distinct() if _has_rows(df.sparkSession, folder) else None
    return {r.part: f"{folder}/part={r.part}" for r in found.collect()} if found is not None else {}


def _has_rows(spark: SparkSession, folder: str) -> bool:
    """Whether a partitioned folder holds any file; without one it has no schema to read."""
    return not spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet"
    ).load(folder).select("path").isEmpty()


def order_index(months: DataFrame) -> DataFrame:
    """Rows and first slot of every range of every month."""
    placed = months.select(
        month_of(F.col("review_date")).alias("month"),
        F.shiftrightunsigned(SLOT, ROW_BITS).alias("range"),
        F.col(SLOT).bitwiseAND((1 << ROW_BITS) - 1).alias("place"),
    )
    return placed.groupBy("month", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))


def _of(prefix: str, known: dict[str, Row]) -> list[str]:
    """Parts of one kind that have rows."""
    return [p for p, e in known.items() if p.startswith(prefix) and e.folder]


def _no_reviews(spark: SparkSession, seeds: dict[str, DataFrame]) -> DataFrame:
    empty = star.classified_reviews(spark.createDataFrame([], schemas.RAW), seeds)
    return empty.drop("vendor_response")


def reviews(spark: SparkSession, store: str, seeds: dict[str, DataFrame]) -> DataFrame:
    """The classified reviews of all months with their dense ``id``."""
    known = tables.entries(spark, store)
    months = _of("month=", known)
    if not months:
        return _no_reviews(spark, seeds).withColumn("id", F.lit(0).cast("bigint"))
    stored = tables.read(spark, store, parts=months, known=known)
    before = Window.orderBy((F.col("month") == UNDATED), "month", "range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each month and range, whatever the number of reviews.
    offsets = tables.read(spark, store, parts=["order"], known=known).select(
        "month", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset")
    )
    placed = stored.withColumns(
        {
            "month": month_of(F.col("review_date")),
            "range": F.shiftrightunsigned(SLOT, ROW_BITS),
            "place": F.col(SLOT).bitwiseAND((1 << ROW_BITS) - 1),
        }
    )
    number = (F.col("offset") + F.col("place") + 1).alias("id")
    columns = [c for c in stored.columns if c != SLOT]
    return placed.join(F.broadcast(offsets), ["month", "range"]).select(number, *columns)


# --- cubes ------------------------------------------------------------------


def signed(changes: DataFrame) -> DataFrame:
    """Every changed version twice: as it was, with sign -1, and as it is, with sign 1."""
    both = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("before").alias("v")),
        F.struct(F.lit(1).alias("sign"), F.col("after").alias("v")),
    )
    rows = changes.select("review_key", F.explode(both).alias("x")).select("review_key", "x.sign", "x.v")
    return rows.where("v IS NOT NULL").select("review_key", "sign", "v.*")


def deltas(changes: DataFrame, seeds: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What the changed versions add to the sums of both cubes."""
    rows = marts.usable(signed(changes))

    def total(when: Column, name: str, value: Column | int = 1) -> Column:
        return F.sum(F.when(when, F.col("sign") * value).otherwise(0)).cast("bigint").alias(name)

    rated = [
        total(F.col("rating").isNotNull(), "rating_sum", F.col("rating")),
        total(F.col("rating").isNotNull(), "rating_count"),
        total(star.high_severity(), "high_count"),
    ]
    tickets = marts.with_ticket_status(rows, seeds)
    return {
        "direction": tickets.groupBy(*CUBES["direction"]).agg(
            total(F.lit(True), COUNTS["direction"]),
            *rated,
            total(F.col("is_ticket"), "ticket_count"),
            total(F.col("is_closed"), "closed_count"),
        ),
        "marketing": rows.groupBy(*CUBES["marketing"]).agg(total(F.lit(True), COUNTS["marketing"]), *rated),
    }


def merged_cells(stored: DataFrame | None, delta: DataFrame, cube: str) -> DataFrame:
    """Stored sums plus deltas; a cell that nothing is left of goes."""
    both = delta if stored is None else stored.unionByName(delta)
    sums = [c for c in delta.columns if c not in CUBES[cube]]
    summed = both.groupBy(*CUBES[cube]).agg(*[F.sum(c).alias(c) for c in sums])
    # The mean of no ratings is NULL, and so is their sum.
    rating = F.when(F.col("rating_count") > 0, F.col("rating_sum"))
    return summed.where(F.col(COUNTS[cube]) != 0).withColumn("rating_sum", F.coalesce(rating, F.lit(0).cast("bigint")))


def cells(spark: SparkSession, store: str, cube: str, seeds: dict[str, DataFrame]) -> DataFrame:
    """The sums of a cube over all months, as the marts take them."""
    known = tables.entries(spark, store)
    parts = _of(f"{cube}=", known)
    if parts:
        stored = tables.read(spark, store, parts=parts, known=known)
    else:
        rows = _versions(_no_reviews(spark, seeds).withColumn("run_id", F.lit("")))
        stored = deltas(rows.select("review_key", F.col("after").alias("before"), "after"), seeds)[cube]
    return stored.withColumn("rating_sum", F.when(F.col("rating_count") > 0, F.col("rating_sum")))


def _date_month(date_id: str) -> Column:
    text = F.col(date_id).cast("string")
    return F.coalesce(F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2)), F.lit(UNDATED))


# --- one step ---------------------------------------------------------------


def advance(spark: SparkSession, raw: str, store: str, seeds: dict[str, DataFrame], buckets: int | None = None) -> list[str]:
    """Merge the raw table's new runs into the store; returns the months that were rewritten."""
    known, landed = tables.entries(spark, store), tables.entries(spark, raw)
    merged = {p.split("=", 1)[1]: e.made_from for p, e in known.items() if p.startswith("run=")}
    folders = {p.split("=", 1)[1]: e.folder for p, e in landed.items() if p.startswith("run_id=")}
    # An emptied run has no folder; its mark says so.
    fresh = [run for run, folder in sorted(folders.items()) if run not in merged or merged[run] != (folder or "")]
    if not fresh:
        return []
    replaced = [run for run in fresh if run in merged]
    commits: dict[str, tuple] = {f"run={run}": (None, folders[run] or "") for run in fresh}
    state = newest(spark, store, known)
    arrived = tables.read(spark, raw, schemas.RAW_RUNS, [f"run_id={r}" for r in fresh], landed)
    if replaced and state is not None:
        # Reviews whose version came with a replaced run are chosen anew among all runs.
        void = state.where(F.col("run_id").isin(replaced)).select("review_key")
        rest = tables.read(spark, raw, schemas.RAW_RUNS, [f"run_id={r}" for r in folders if r not in fresh], landed)
        others = rest.withColumn("review_key", star.review_key()).join(void, "review_key", "left_semi")
        arrived = arrived.unionByName(others.drop("review_key"))
    classified = star.with_keys(star.newest_versions(arrived), seeds)
    fat = written(classified.drop("vendor_response"), "arrived")
    versions = _versions(fat)
    if state is None:
        count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        none = F.lit(None).cast(versions.schema["after"].dataType).alias("before")
        changes = versions.select("review_key", none, "after")
    else:
        count = int(known["newest"].made_from)
        changes = changed_versions(state, versions, replaced)
    changes = written(changes, "changes")
    touched = _touched(changes)
    if touched:
        commits |= _merge(spark, store, state, changes, fat, count, seeds, known, touched)
    tables.commit(spark, store, commits, known)
    return touched


def _touched(changes: DataFrame) -> list[str]:
    """Months that a changed version leaves or enters."""
    months = changes.select(F.explode(F.array("before.month", "after.month")).alias("month")).where("month IS NOT NULL")
    return sorted(r.month for r in months.distinct().collect())


def _merge(
    spark: SparkSession,
    store: str,
    state: DataFrame | None,
    changes: DataFrame,
    fat: DataFrame,
    count: int,
    seeds: dict[str, DataFrame],
    known: dict[str, Row],
    touched: list[str],
) -> dict[str, tuple]:
    """Write the new parts of one step; returns their entries."""
    entries: dict[str, tuple] = {}
    folder = tables.new_folder(store, "newest")
    if state is None:
        # Dealt by bucket, each bucket is one file, and not one of each task.
        rows = changes.select("review_key", "after.*").repartition(count, "review_key")
    else:
        rows = merged_versions(state, changes)
    rows.select("review_key", *NAMES).write.insertInto(_bucketed(spark, folder, count))
    entries["newest"] = (folder, str(count))

    # The touched months without the superseded versions, with the new ones.
    if state is None:
        rows = fat.drop("run_id")  # nothing to lose against
    else:
        won = changes.where("after IS NOT NULL").select("review_key", F.col("after.run_id").alias("run_id"))
        rows = fat.join(won, ["review_key", "run_id"], "left_semi").drop("run_id")
    there = [p for p in _of("month=", known) if p.split("=")[1] in touched]
    if there:
        old = tables.read(spark, store, parts=there, known=known).drop(SLOT)
        rows = old.join(changes.select("review_key"), "review_key", "left_anti").unionByName(rows)
    folder = tables.new_folder(store, "months")
    found = _by_month(slotted(rows, star.dated_order()), folder, month_of(F.col("review_date")))
    entries |= {f"month={m}": (found.get(m), None) for m in touched}

    index = order_index(spark.read.parquet(*found.values())) if found else None
    if "order" in known:
        rest = tables.read(spark, store, parts=["order"], known=known).where(~F.col("month").isin(touched))
        index = rest if index is None else index.unionByName(rest)
    folder = tables.new_folder(store, "order")
    index.coalesce(1).write.parquet(folder)  # one row for each month and range
    entries["order"] = (folder, None)

    for cube, delta in deltas(changes, seeds).items():
        there = [p for p in _of(f"{cube}=", known) if p.split("=")[1] in touched]
        stored = tables.read(spark, store, parts=there, known=known) if there else None
        folder = tables.new_folder(store, cube)
        found = _by_month(merged_cells(stored, delta, cube), folder, _date_month("date_id"))
        entries |= {f"{cube}={m}": (found.get(m), None) for m in touched}
    return entries
