"""Every operator as a query over the test tables: ``name -> (spark, sf_dir) -> frame``.

Each query reads the given tables whole and composes the package's own operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from avisgrid import schemas
from avisgrid.functions import classify as cl
from avisgrid.functions import taxonomy as tx
from avisgrid.functions import text as tt
from avisgrid.functions import times
from avisgrid.operators import landing, verdicts
from avisgrid.plans import activation, daily, incremental, ledger, marts, quality, star
from avisgrid.session import prepare, scratch_path, spread, written
from avisgrid.sources import fixture as fx
from avisgrid.sources import payloads as pl
from avisgrid.sources import reference_data, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


CLASSIFIED_AT = "2024-02-05 07:00:00"
KEY = ("source_code", "source_review_id", "collected_at")


def as_of() -> Column:
    return fx.ts(fx.AS_OF)


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    refined = cl.refine(fx.landed_reviews(spark, sf_dir), fx.ts(CLASSIFIED_AT))
    return tables.raw_columns(refined)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.classified_reviews(raw_reviews(spark, sf_dir), reference_data.seeds(spark))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.numbered_reviews(classified(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")


# --- sources and landing ----------------------------------------------------


@query
def ingest_app_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.app_store_reviews(fx.app_store_payloads(spark, sf_dir)).select(*pl.REVIEW_COLUMNS)


@query
def ingest_trustpilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.trustpilot_reviews(fx.trustpilot_payloads(spark, sf_dir)).select(*pl.REVIEW_COLUMNS)


@query
def ingest_google_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.google_play_reviews(fx.google_play_payloads(spark, sf_dir)).select(
        *pl.REVIEW_COLUMNS
    )


@query
def rejected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was kept of each source, and why pages and entries were not, from one reading."""
    return pl.reading_counts(landing.parsed(fx.payloads(spark, sf_dir)))


@query
def fallback_review_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    given = F.when(eid % 3 == 0, None).when(eid % 3 == 1, "").otherwise(eid.cast("string"))
    return fx.events(spark, sf_dir).select(
        "event_id",
        pl.fallback_id(given, "as_", times.iso_utc(ts)).alias("app_store_id"),
        pl.fallback_id(given, "tp_", times.iso_utc(F.date_trunc("second", ts))).alias(
            "trustpilot_id"
        ),
    )


@query
def parse_ts_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of every event written in one of eight ways, three of them unreadable."""
    eid = F.col("event_id")
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    ways = [
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.concat(
            F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"),
            F.lit("+02:00"),
        ),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.date_format(ts, "yyyy-MM-dd"),
        F.date_format(ts, "yyyyMMdd"),
        F.lit(""),
        F.lit("pas une date"),
        F.lit("2024-13-45T99:00:00Z"),
    ]
    written_as = F.element_at(F.array(*ways), (eid % 8 + 1).cast("int"))
    return fx.events(spark, sf_dir).select(
        "event_id", times.parse_ts_utc(written_as).alias("parsed")
    )


@query
def paris_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events spread over a year, so both clock changes are crossed."""
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp") + F.make_dt_interval(days=(eid % 330).cast("int"))
    return fx.events(spark, sf_dir).select("event_id", times.paris_date(ts).alias("paris_date"))


@query
def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = landing.recent(fx.reviews(spark, sf_dir), as_of())
    return kept.select("source_review_id", "source_code", "review_date")


@query
def join_title_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of three kinds in front of every document and review text."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    revs = fx.reviews(spark, sf_dir).select(F.col("event_id").alias("id"), "text")
    n = F.col("id")
    title = F.when(n % 4 == 0, None).when(n % 4 == 1, "  ").when(n % 4 == 2, "...").otherwise("Avis")
    both = docs.select(F.lit("document").alias("kind"), "id", "text").unionByName(
        revs.select(F.lit("review").alias("kind"), "id", "text")
    )
    return both.select("kind", "id", tt.join_title_body(title, F.col("text")).alias("text"))


@query
def cap_per_source_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = landing.capped(fx.arrived_reviews(spark, sf_dir), tx.MAX_PER_SOURCE_BRAND)
    return kept.select("source_code", "brand_code", "source_review_id", "arrival_page")


@query
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with different columns in one frame, stamped with the run time."""
    base = fx.reviews(spark, sf_dir).drop("event_id")
    frames = [
        base.where(F.col("source_code") == "google_play"),
        base.where(F.col("source_code") == "app_store").drop(
            "vendor_response", "vendor_response_at"
        ),
        base.where(F.col("source_code") == "trustpilot").drop("app_version"),
    ]
    return landing.union_sources(frames).withColumn("collected_at", as_of())


@query
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = landing.keep_first(fx.arrived_reviews(spark, sf_dir), list(fx.BRANDS))
    return kept.select("source_code", "source_review_id", "brand_code", "arrival_page")


@query
def land_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole landing run: payloads of three sources, window, cap, dedup, stamp."""
    return landing.land(fx.payloads(spark, sf_dir), as_of(), list(fx.BRANDS))


@query
def bronze_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = scratch_path(spark, "bronze")
    tables.write_run(fx.landed_reviews(spark, sf_dir), bronze, "20240205T060000Z")
    return tables.read_run(spark, bronze, "20240205T060000Z")


@query
def latest_run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs by collection day; only the files of the newer one are read."""
    bronze = scratch_path(spark, "bronze")
    landed = fx.landed_reviews(spark, sf_dir)
    for run_id, collected in (
        ("20240204T060000Z", fx.OLDER_COLLECTED_AT),
        ("20240205T060000Z", fx.COLLECTED_AT),
    ):
        tables.write_run(landed.where(F.col("collected_at") == fx.ts(collected)), bronze, run_id)
    return tables.read_run(spark, bronze)


@query
def raw_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "raw")
    tables.write_raw(cl.refine(fx.landed_reviews(spark, sf_dir), fx.ts(CLASSIFIED_AT)), path)
    return tables.read(spark, path, schemas.RAW)


@query
def nan_becomes_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth score is not a number when the raw table is written."""
    number = F.col("source_review_id").cast("bigint")
    score = F.when(number % 5 == 0, F.lit(float("nan"))).otherwise(F.col("severity_text_score"))
    return tables.raw_columns(raw_reviews(spark, sf_dir).withColumn("severity_text_score", score)).select(
        *KEY, "severity_text_score", "severity_rating_score"
    )


@query
def stored_verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the second pass from the rows that it wrote."""
    latest = _latest_raw(spark, sf_dir)
    return verdicts.stored_stats(verdicts.reclassify(latest, fx.scripted_scorer))


@query
def seeds_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews per brand and source with the typed attributes of both seeds."""
    seeds = reference_data.seeds(spark)
    counts = fx.reviews(spark, sf_dir).groupBy("brand_code", "source_code").agg(
        F.count("*").alias("n_reviews")
    )
    brand = seeds["brands"].select(F.col("code").alias("brand_code"), "is_focus")
    source = seeds["sources"].select(
        F.col("code").alias("source_code"), F.col("id").alias("source_id"), "type", "url"
    )
    return counts.join(brand, "brand_code").join(source, "source_code")


# --- quality filter ---------------------------------------------------------


@query
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.with_quality(fx.landed_reviews(spark, sf_dir)).select(
        *KEY, "is_exploitable", "exclusion_reason"
    )


@query
def quality_filter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on whole multilingual documents."""
    return cl.with_quality(documents(spark, sf_dir)).select(
        "doc_id", "is_exploitable", "exclusion_reason"
    )


@query
def quality_filter_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.with_quality(turns(spark, sf_dir)).select(
        "conv_id", "turn", "is_exploitable", "exclusion_reason"
    )


@query
def quality_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce("exclusion_reason", F.lit("exploitable")).alias("reason")
    checked = cl.with_quality(fx.landed_reviews(spark, sf_dir))
    return checked.groupBy(reason).agg(F.count("*").alias("n_reviews"))


# --- taxonomy ---------------------------------------------------------------


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tt.normalize(F.col("text")).alias("folded"))


@query
def strip_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"
    )
    revs = fx.reviews(spark, sf_dir).select(
        F.lit("review").alias("kind"), F.col("event_id").alias("id"), "text"
    )
    cleaned = tt.strip_negation(tt.normalize(F.col("text")))
    return docs.unionByName(revs).select("kind", "id", cleaned.alias("searched"))


@query
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    searched = tt.strip_negation(tt.normalize(F.col("text")))
    scored = fx.landed_reviews(spark, sf_dir).select(
        *KEY, cl.category_scores(searched).alias("scores")
    )
    return scored.select(*KEY, "scores.*")


@query
def category_scores_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    searched = tt.strip_negation(tt.normalize(F.col("text")))
    scored = documents(spark, sf_dir).select("doc_id", cl.category_scores(searched).alias("scores"))
    return scored.select("doc_id", "scores.*")


def _refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.with_text_classes(fx.landed_reviews(spark, sf_dir))


@query
def classify_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir).select(*KEY, "category_code")


@query
def severity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir).select(*KEY, "severity_rating_score", "severity_text_score")


@query
def classify_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir).select(*KEY, "severity_code")


@query
def classify_persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir).select(*KEY, "persona_code")


@query
def refine_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_reviews(spark, sf_dir)


@query
def refine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classifiers on whole documents; the document number gives the rating."""
    rated = documents(spark, sf_dir).withColumn("rating", (F.col("doc_id") % 6).cast("int"))
    return cl.with_text_classes(rated).drop("text")


# --- second-pass model ------------------------------------------------------


@query
def model_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.candidates(star.staged(raw_reviews(spark, sf_dir)))


@query
def model_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.prompts(verdicts.candidates(star.staged(raw_reviews(spark, sf_dir))))


@query
def model_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts through an injected scorer that also fails on some rows."""
    latest = star.staged(raw_reviews(spark, sf_dir))
    return verdicts.classify_candidates(latest, fx.scripted_scorer)


def _stored_verdicts(raw: DataFrame) -> DataFrame:
    return verdicts.parse_replies(fx.model_replies(verdicts.candidates(raw)))


def _latest_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table of one run as written, since verdicts are made from it and merged back."""
    latest = star.staged(raw_reviews(spark, sf_dir)).select(*schemas.RAW.fieldNames())
    return written(latest, "raw")


@query
def parse_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_verdicts(_latest_raw(spark, sf_dir)).drop("reply")


@query
def apply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _latest_raw(spark, sf_dir)
    return verdicts.apply_verdicts(raw, _stored_verdicts(raw)).select(
        "source_review_id", "source_code", "category_code", "category_source", "severity_code"
    )


@query
def reclassify_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring and merge in one narrow step."""
    latest = star.staged(raw_reviews(spark, sf_dir)).select(*schemas.RAW.fieldNames())
    return verdicts.reclassify(latest, fx.scripted_scorer).select(
        "source_review_id", "source_code", "category_code", "category_source", "severity_code"
    )


@query
def verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _latest_raw(spark, sf_dir)
    return verdicts.verdict_stats(raw, _stored_verdicts(raw))


# --- staging and star -------------------------------------------------------


@query
def stg_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.staged(raw_reviews(spark, sf_dir)).select(
        "source_review_id", "source_code", "brand_code", "review_date", "rating", "text",
        "collected_at", "severity_code",
    )


@query
def multi_run_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the second repeats every tenth review with another text and the same times."""
    first = raw_reviews(spark, sf_dir)
    again = first.where(F.col("source_review_id").cast("bigint") % 10 == 0)
    again = again.withColumn("text", F.concat("text", F.lit(" bis")))
    runs = again.withColumn("run_id", F.lit("r2")).unionByName(first.withColumn("run_id", F.lit("r1")))
    return star.staged(runs).select("source_code", "source_review_id", "collected_at", "text")


# --- the star by touched month ----------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three runs: most reviews; the rest and late texts with the same times; corrected and moved reviews."""
    landed = spread(fx.landed_reviews(spark, sf_dir), "source_review_id", "collected_at", "review_date")
    raw = tables.raw_columns(cl.refine(landed, fx.ts(CLASSIFIED_AT)))
    n = F.col("source_review_id").cast("bigint")
    late = F.when(n % 10 == 0, F.concat("text", F.lit(" bis"))).otherwise(F.col("text"))
    moved = {
        "review_date": F.col("review_date") + F.expr("INTERVAL 40 DAYS"),
        "rating": F.lit(2),
        "collected_at": F.col("collected_at") + F.expr("INTERVAL 1 DAY"),
    }
    return {
        "r1": raw.where(n % 7 != 0),
        "r2": raw.where((n % 10 == 0) | (n % 7 == 0)).withColumn("text", late),
        "r3": raw.where(n % 15 == 0).withColumns(moved),
    }


def _advanced(spark: SparkSession, sf_dir: str, reload: bool = False) -> str:
    """A store that took the runs one after the other; with ``reload`` the second one comes again, empty."""
    root = scratch_path(spark, "incremental")
    raw, store, seeds = f"{root}/raw", f"{root}/star", reference_data.seeds(spark)
    runs = list(_runs(spark, sf_dir).items())
    if reload:
        runs.append(("r2", runs[1][1].where("false")))
    for step, (run, rows) in enumerate(runs):
        tables.load_raw_run(tables.raw_columns(rows), raw, run, f"landed-{step}")
        incremental.advance(spark, raw, store, seeds)
    return store


def _incremental_facts(spark: SparkSession, store: str) -> DataFrame:
    return star.fact_reviews(incremental.reviews(spark, store, reference_data.seeds(spark)))


@query
def incremental_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review facts after three runs, only touched months rewritten, all numbers dense."""
    return _incremental_facts(spark, _advanced(spark, sf_dir))


@query
def incremental_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review facts after a run was taken back."""
    return _incremental_facts(spark, _advanced(spark, sf_dir, reload=True))


@query
def incremental_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucketed newest versions after three runs with ties."""
    return incremental.newest(spark, _advanced(spark, sf_dir)).drop("month", "run_id")


@query
def incremental_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthesis from cells that changed by signed deltas."""
    seeds = reference_data.seeds(spark)
    cells = incremental.cells(spark, _advanced(spark, sf_dir, reload=True), "direction", seeds)
    return marts.synthesis_of(cells, seeds)


@query
def incremental_marketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = reference_data.seeds(spark)
    return marts.voice_of(incremental.cells(spark, _advanced(spark, sf_dir), "marketing", seeds), seeds)


@query
def response_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.staged(raw_reviews(spark, sf_dir)).select(
        "source_review_id", "source_code", "response_latency_days", "vendor_responded"
    )


@query
def resolve_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select(
        "review_key", "source_review_id", "date_id", "brand_id", "source_id", "category_id",
        "persona_id", "severity_id",
    )


@query
def dim_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of all dimensions, every typed column, and the number of reviews each has."""
    seeds = reference_data.seeds(spark)
    rows = classified(spark, sf_dir)
    keys = {
        "dim_brand": "brand_id",
        "dim_source": "source_id",
        "dim_category": "category_id",
        "dim_severity": "severity_id",
        "dim_persona": "persona_id",
    }
    members = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(k).alias("id")) for d, k in keys.items()]
    )
    used = (
        rows.select(F.inline(members))
        .groupBy("dimension", "id")
        .agg(F.count("*").alias("n_reviews"))
    )
    labels = None
    for name in star.DIMENSIONS:
        dim = star.dimension(seeds, name)
        rest = [F.col(c).cast("string") for c in dim.columns if c not in ("id", "code", "label", "description")]
        dim = dim.select(
            F.lit(name).alias("dimension"), "id", "code", "label", F.concat_ws("|", *rest).alias("detail")
        )
        labels = dim if labels is None else labels.unionByName(dim)
    return labels.join(used, ["dimension", "id"], "left").withColumn(
        "n_reviews", F.coalesce("n_reviews", F.lit(0).cast("bigint"))
    )


@query
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar with the number of reviews of each day."""
    daily = (
        fx.reviews(spark, sf_dir)
        .groupBy(times.date_id(F.col("review_date")).alias("date_id"))
        .agg(F.count("*").alias("n"))
    )
    return (
        star.calendar(spark)
        .join(daily, "date_id", "left")
        .withColumn("n_reviews", F.coalesce("n", F.lit(0).cast("bigint")))
        .drop("n")
    )


@query
def fact_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.fact_reviews(numbered(spark, sf_dir))


@query
def fact_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.fact_classifications(numbered(spark, sf_dir))


@query
def fact_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = reference_data.seeds(spark)
    return star.fact_tickets(star.numbered_tickets(numbered(spark, sf_dir), seeds))


# --- marts ------------------------------------------------------------------


@query
def per_day_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = reference_data.seeds(spark)
    daily = marts.per_day_brand(marts.daily_cells(classified(spark, sf_dir), seeds), seeds)
    return daily.withColumns(
        {
            "avg_rating": marts.rounded(F.col("avg_rating"), 6),
            "share_critical": marts.rounded(F.col("share_critical"), 6),
        }
    )


@query
def competitor_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = reference_data.seeds(spark)
    daily = marts.per_day_brand(marts.daily_cells(classified(spark, sf_dir), seeds), seeds)
    return marts.competitor_avg(daily).withColumn(
        "competitor_avg_rating", marts.rounded(F.col("competitor_avg_rating"), 6)
    )


def _worked_statuses(rows: DataFrame) -> DataFrame:
    """A status per review as a ticket desk would report it."""
    number = F.col("source_review_id").cast("bigint")
    return rows.select("review_key", (number % 4 + 1).cast("int").alias("status_id"))


@query
def ticket_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of closed tickets per day, with statuses from a ticket desk."""
    rows = classified(spark, sf_dir)
    cells = marts.daily_cells(rows, reference_data.seeds(spark), _worked_statuses(rows))
    return marts.ticket_resolution(cells).withColumn(
        "resolution_rate", marts.rounded(F.col("resolution_rate"), 6)
    )


@query
def dm_direction_synthese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.direction_synthesis(classified(spark, sf_dir), reference_data.seeds(spark))


@query
def marketing_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.marketing_cells(classified(spark, sf_dir))


@query
def focus_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = marts.marketing_cells(classified(spark, sf_dir))
    return marts.focus_baseline(cells, reference_data.seeds(spark)).withColumn(
        "focus_volume", marts.rounded(F.col("focus_volume"), 6)
    )


@query
def dm_marketing_voc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.marketing_voice(classified(spark, sf_dir), reference_data.seeds(spark))


@query
def dm_finance_litiges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.finance_disputes(numbered(spark, sf_dir), reference_data.seeds(spark))


@query
def dm_sav_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = reference_data.seeds(spark)
    rows = star.numbered_tickets(numbered(spark, sf_dir), seeds)
    return marts.support_tickets(rows, seeds, as_of())


@query
def mart_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = marts.marketing_voice(classified(spark, sf_dir), reference_data.seeds(spark))
    return marts.mart_counts(mart)


# --- activation -------------------------------------------------------------


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.weekly_high(classified(spark, sf_dir), reference_data.seeds(spark))


def _spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.spikes(activation.recent_weeks(_weekly(spark, sf_dir)))


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    return activation.tickets(activation.critical_selection(rows, reference_data.seeds(spark)))


def _ledger(rows: DataFrame) -> DataFrame:
    """Keys an earlier run has pushed: every review with an even number, some twice."""
    number = F.col("source_review_id").cast("bigint")
    times_pushed = F.when(number % 2 == 0, 1 + (number % 3).cast("int")).otherwise(0)
    return rows.select(
        "review_key", F.explode(F.array_repeat(F.lit(1), times_pushed)).alias("n")
    ).select("review_key")


def _pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(fx.reviews(spark, sf_dir).withColumn("review_key", star.review_key()))


@query
def weekly_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekly(spark, sf_dir)


@query
def recent_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.recent_weeks(_weekly(spark, sf_dir)).withColumn(
        "rn", F.col("rn").cast("bigint")
    )


@query
def spike_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spikes(spark, sf_dir)


@query
def alert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.alert_records(_spikes(spark, sf_dir), as_of())


@query
def critical_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    return activation.critical_selection(rows, reference_data.seeds(spark))


@query
def ticket_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review numbered newest first, past the four-digit padding."""
    rows = classified(spark, sf_dir).select("review_key", "review_date", "source_review_id")
    order = [F.col("review_date").desc_nulls_first(), F.col("review_key").asc()]
    counted = star.dense_id(rows, order, "n")
    return counted.select("review_key", activation.ticket_number(F.col("n")).alias("ticket_id"))


@query
def owner_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified(spark, sf_dir)
    return rows.groupBy(
        "category_code", activation.owner_team(F.col("category_code")).alias("owner_team")
    ).agg(F.count("*").alias("n_reviews"))


@query
def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tickets(spark, sf_dir)


@query
def tickets_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported tickets as a reader of the file sees them."""
    path = scratch_path(spark, "tickets-csv")
    tables.write_csv(_tickets(spark, sf_dir).select(*schemas.TICKETS), path)
    schema = (
        "ticket_id string, review_id bigint, occurred_at timestamp, brand string, source string, "
        "category string, severity string, rating int, status string, owner_team string, excerpt string"
    )
    return tables.read_csv(spark, path, schema)


@query
def alerts_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported alerts as a reader of the file sees them."""
    path = scratch_path(spark, "alerts-csv")
    tables.write_csv(activation.alert_records(_spikes(spark, sf_dir), as_of()), path)
    schema = (
        "alert_id string, detected_at timestamp, brand string, category string, current_week date, "
        "current_high bigint, baseline_avg_high double, ratio double"
    )
    return tables.read_csv(spark, path, schema)


@query
def new_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = activation.new_tickets(_tickets(spark, sf_dir), _pushed(spark, sf_dir))
    return fresh.select("ticket_id", "review_key", "owner_team")


@query
def ledger_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after three days: part of the tickets, all of them, and the second day again."""
    path = scratch_path(spark, "ledger")
    rows = written(_tickets(spark, sf_dir).select("review_key", "review_id"), "tickets")
    for run, chosen in (("d1", F.col("review_id") % 3 == 0), ("d2", F.lit(True)), ("d2", F.col("review_id") % 2 == 0)):
        known = ledger.pushed_by_others(spark, path, run)
        ledger.record(spark, path, activation.new_tickets(rows.where(chosen), known), run)
    return ledger.read(spark, path)


@query
def ticket_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.ticket_payloads(_tickets(spark, sf_dir))


@query
def ticket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.ticket_stats(_tickets(spark, sf_dir), _pushed(spark, sf_dir))


@query
def run_recap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.run_recap(
        _tickets(spark, sf_dir), _spikes(spark, sf_dir), _pushed(spark, sf_dir)
    )


def _day(spark: SparkSession, sf_dir: str) -> daily.Warehouse:
    """A whole day from payloads to recap, every table written; the reviews of its 30 days."""
    root = scratch_path(spark, "day")
    payloads = fx.payloads(spark, sf_dir)
    daily.run_day(spark, payloads, root, "20240210T000000Z", as_of(), fx.scripted_scorer)
    return daily.Warehouse(spark, root)


@query
def daily_recap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(spark, sf_dir).read("recap")


@query
def daily_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review facts that the daily run wrote."""
    return _day(spark, sf_dir).read("fact_reviews")


@query
def daily_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthesis that the daily run wrote, after the second pass."""
    return _day(spark, sf_dir).read("dm_direction_synthese")


# --- quality checks ---------------------------------------------------------


def _faulty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw reviews with known faults, so that every raw check has something to find."""
    number = F.col("source_review_id").cast("bigint")
    return raw_reviews(spark, sf_dir).withColumns(
        {
            "source_code": F.when(number % 11 == 0, None)
            .when(number % 13 == 0, "forum")
            .otherwise(F.col("source_code")),
            "brand_code": F.when(number % 17 == 0, "autre").otherwise(F.col("brand_code")),
            "review_date": F.when(number % 19 != 0, F.col("review_date")),
            "severity_code": F.when(number % 23 == 0, "urgent").otherwise(F.col("severity_code")),
            "category_source": F.when(number % 29 != 0, F.col("category_source")),
        }
    )


def _check_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All checked tables built from the faulty raw reviews."""
    seeds = reference_data.seeds(spark)
    raw = written(_faulty_raw(spark, sf_dir), "raw")
    rows = star.numbered_reviews(star.classified_reviews(raw, seeds))
    return {
        "raw_reviews": raw,
        "fact_reviews": star.fact_reviews(rows),
        "fact_classifications": written(star.fact_classifications(rows), "classifications"),
        "fact_tickets": star.fact_tickets(star.numbered_tickets(rows, seeds)),
        **{n: star.dimension(seeds, n) for n in star.DIMENSIONS},
        "dim_date": star.calendar(spark),
    }


@query
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.row_checks({"raw_reviews": _faulty_raw(spark, sf_dir)})
    return found.where(F.col("check_name") == "not_null")


@query
def dq_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.row_checks({"raw_reviews": _faulty_raw(spark, sf_dir)})
    return found.where(F.col("check_name") == "accepted_values")


@query
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id check on raw reviews, where every tenth id comes twice."""
    tables_ = {"raw_reviews": raw_reviews(spark, sf_dir)}
    return quality.unique_checks(tables_, {"raw_reviews": ("source_review_id",)})


@query
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 46 declared checks over all tables."""
    return quality.report(_check_tables(spark, sf_dir))


@query
def dq_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks at which the gate stops a day with faulty raw reviews."""
    return quality.failed_checks(quality.report(_check_tables(spark, sf_dir)))
