"""One daily run over a warehouse folder: land, refine, model, check, activate, recap.

Every step writes its tables to the warehouse and the next step reads them back, so a
lost executor or a restarted step never reaches back further than one step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from avisgrid import schemas
from avisgrid.functions import classify as cl
from avisgrid.functions import taxonomy as tx
from avisgrid.operators import landing, verdicts
from avisgrid.operators.ranking import numbered
from avisgrid.plans import activation, incremental, ledger, marts, quality, star
from avisgrid.session import prepare, spread, written
from avisgrid.sources import reference_data, tables
from avisgrid.sources.payloads import reading_counts


@dataclass(frozen=True)
class Warehouse:
    """Committed tables below one shared root (see ``sources.tables``)."""

    spark: SparkSession
    root: str
    incremental: bool = False  # rebuild touched months only (see ``plans.incremental``)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def bronze(self) -> str:
        return self.path("bronze")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        return self.spark.read.parquet(tables.put(df, self.path(name)))

    def read(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.path(name))

    @property
    def store(self) -> str:
        return self.path("star")

    def reviews(self, seeds: dict[str, DataFrame]) -> DataFrame:
        """Classified reviews with their dense ids."""
        if self.incremental:
            return incremental.reviews(self.spark, self.store, seeds)
        return numbered(self.read("fact_base"))

    def fact(self, name: str, seeds: dict[str, DataFrame]) -> DataFrame:
        """A fact table; the two large ones are views of the months where those are kept up to date."""
        views = {"fact_reviews": star.fact_reviews, "fact_classifications": star.fact_classifications}
        if self.incremental and name in views:
            return views[name](self.reviews(seeds))
        return self.read(name)


def land_run(
    house: Warehouse,
    payloads: dict[str, DataFrame],
    run_id: str,
    as_of: Column,
    days: int = tx.WINDOW_DAYS,
    cap: int = 0,
    seeds_folder: str | None = None,
) -> str:
    """Payloads to one bronze run; returns its folder.

    Entries are parsed once. How many were kept of each source, and why the others were not, is the
    run's part of ``reading_counts``.
    """
    known = reference_data.seed(house.spark, "brands", seeds_folder)
    brands = [r.code for r in known.orderBy("id").collect()]
    entries = {s: written(df, "entries") for s, df in landing.parsed(payloads).items()}
    folder = tables.write_run(landing.land_parsed(entries, as_of, brands, days, cap), house.bronze, run_id)
    counts = reading_counts(entries).withColumn("run_id", F.lit(run_id))
    tables.put(counts, house.path("reading_counts"), f"run_id={run_id}")
    return folder


def load_run(
    house: Warehouse,
    as_of: Column,
    run_id: str | None = None,
    scorer: verdicts.Scorer | None = None,
) -> int:
    """Refine every run that is not loaded yet, or landed anew since, into the raw table; returns the rows added.

    The raw table has a part for each run with the landed version it was made from, so incremental landing keeps
    its history and a load that was left out is made up for. A run that is empty now leaves the
    table and is not refined again. ``run_id`` names a run to load again. With a
    scorer the unclassified reviews go through the second pass on the way; what came of it is the
    run's part of ``verdict_stats``.
    """
    landed = tables.runs(house.spark, house.bronze)
    if not landed:
        raise tables.NoRunError(f"no run below {house.bronze}")
    raw = house.path("raw_reviews")
    loaded = {run: e.made_from for run, e in tables.runs(house.spark, raw).items()}
    added = 0
    for run, entry in landed.items():
        if run == run_id or loaded.get(run) != entry.folder:
            stored = tables.read_run(house.spark, house.bronze, run)
            refined = cl.refine(spread(stored, "source_code", "source_review_id", "review_date"), as_of)
            refined = tables.raw_columns(refined)
            if scorer is not None:
                refined = verdicts.reclassify(refined, scorer)
            added += tables.load_raw_run(refined, raw, run, entry.folder)
            if scorer is not None:
                stored = tables.read(house.spark, raw, schemas.RAW_RUNS, [f"run_id={run}"])
                stats = verdicts.stored_stats(stored).withColumn("run_id", F.lit(run))
                tables.put(stats, house.path("verdict_stats"), f"run_id={run}")
    return added


def read_raw(house: Warehouse) -> DataFrame:
    """The raw reviews of all loaded runs with their run; empty before the first."""
    return tables.read(house.spark, house.path("raw_reviews"), schemas.RAW_RUNS)


def build_star(house: Warehouse, seeds: dict[str, DataFrame]) -> None:
    """Dimensions and facts from the raw table.

    ``fact_base`` holds the classified reviews sorted by date with their slots; every
    fact and mart is a projection or aggregate of it. In an incremental warehouse the months that new
    runs touch take its place, and no history is written again.
    """
    for name in star.DIMENSIONS:
        house.write(name, star.dimension(seeds, name))
    house.write("dim_date", star.calendar(house.spark))
    if house.incremental:
        incremental.advance(house.spark, house.path("raw_reviews"), house.store, seeds)
        base = house.reviews(seeds)
    else:
        house.write("fact_base", star.dated_reviews(star.classified_reviews(read_raw(house), seeds)))
        base = house.reviews(seeds)
        house.write("fact_reviews", star.fact_reviews(base))
        house.write("fact_classifications", star.fact_classifications(base))
    house.write("ticket_base", star.numbered_tickets(base, seeds))
    house.write("fact_tickets", star.fact_tickets(house.read("ticket_base")))


def build_marts(house: Warehouse, seeds: dict[str, DataFrame], as_of: Column) -> None:
    base = house.reviews(seeds)
    if house.incremental:
        direction, marketing = (incremental.cells(house.spark, house.store, c, seeds) for c in incremental.CUBES)
    else:
        direction, marketing = marts.daily_cells(base, seeds), marts.marketing_cells(base)
    house.write("dm_direction_synthese", marts.synthesis_of(direction, seeds))
    house.write("dm_marketing_voc", marts.voice_of(marketing, seeds))
    house.write("dm_finance_litiges", marts.finance_disputes(base, seeds))
    house.write("dm_sav_tickets", marts.support_tickets(house.read("ticket_base"), seeds, as_of))


CHECKED = (
    "fact_reviews", "fact_classifications", "fact_tickets", *star.DIMENSIONS,
    "dim_date",
)


def check(house: Warehouse, seeds: dict[str, DataFrame]) -> DataFrame:
    """All declared checks; the report is kept, whatever the outcome."""
    checked = {**{t: house.fact(t, seeds) for t in CHECKED}, "raw_reviews": read_raw(house)}
    return house.write("quality_report", quality.report(checked))


def find_alerts(house: Warehouse, seeds: dict[str, DataFrame], as_of: Column) -> DataFrame:
    weekly = activation.weekly_high(house.reviews(seeds), seeds)
    found = activation.spikes(activation.recent_weeks(weekly))
    alerts = house.write("alerts", activation.alert_records(found, as_of))
    tables.write_csv(alerts, house.path("alerts.csv"))
    return alerts


def read_ledger(house: Warehouse, before_run: str) -> DataFrame:
    """Keys pushed by other runs."""
    return ledger.pushed_by_others(house.spark, house.path("ledger"), before_run)


def route_tickets(house: Warehouse, seeds: dict[str, DataFrame], run_id: str) -> DataFrame:
    """Ticket export, payloads of the new tickets and their ledger entries."""
    chosen = activation.critical_selection(house.reviews(seeds), seeds)
    tickets = house.write("tickets", activation.tickets(chosen))
    tables.write_csv(tickets.select(*schemas.TICKETS), house.path("tickets.csv"))
    fresh = activation.new_tickets(tickets, read_ledger(house, run_id))
    payloads = house.write(f"ticket_payloads/run_id={run_id}", activation.ticket_payloads(fresh))
    ledger.record(house.spark, house.path("ledger"), payloads, run_id)
    return tickets


def run_day(
    spark: SparkSession,
    payloads: dict[str, DataFrame],
    root: str,
    run_id: str,
    as_of: Column,
    scorer: verdicts.Scorer | None = None,
    cap: int = 0,
    seeds_folder: str | None = None,
    incrementally: bool = False,
) -> DataFrame:
    """A whole day.  Failed checks stop alerts and tickets.

    Whatever step fails, the recap is written anew: a recap of an earlier day never stays. ``run_status``
    says how far the run came.
    """
    house = Warehouse(prepare(spark), root, incrementally)
    seeds = reference_data.seeds(spark, seeds_folder)
    steps = (
        ("land", lambda: land_run(house, payloads, run_id, as_of, cap=cap, seeds_folder=seeds_folder)),
        ("load", lambda: load_run(house, as_of, run_id, scorer)),
        ("star", lambda: build_star(house, seeds)),
        ("marts", lambda: build_marts(house, seeds, as_of)),
        ("checks", lambda: quality.gate(check(house, seeds))),
        ("alerts", lambda: find_alerts(house, seeds, as_of)),
        ("tickets", lambda: route_tickets(house, seeds, run_id)),
    )
    found, reached = {}, ""
    try:
        for reached, step in steps:
            found[reached] = step()
        reached = "recap"
        recap = activation.run_recap(found["tickets"], found["alerts"], read_ledger(house, run_id))
        written_recap = house.write("recap", recap)
        _note(house, run_id, reached, None)
        return written_recap
    except Exception as error:
        # A fault while noting the failure must not hide it.
        for write in (
            lambda: house.write("recap", activation.empty_recap(spark)),
            lambda: _note(house, run_id, reached, error),
        ):
            try:
                write()
            except Exception as other:  # noqa: BLE001
                error.add_note(f"and the failure could not be noted: {other}")
        raise


def _note(house: Warehouse, run_id: str, step: str, error: Exception | None) -> None:
    """The run's part of ``run_status``: the last step begun and the error that ended it."""
    text = None if error is None else f"{type(error).__name__}: {error}"[:1000]
    row = house.spark.createDataFrame([(run_id, step, text)], "run_id string, step string, error string")
    tables.put(row.coalesce(1), house.path("run_status"), f"run_id={run_id}")
