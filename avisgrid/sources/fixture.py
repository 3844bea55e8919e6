"""Review fixture: landed reviews derived row by row from the ``events`` table.

Integer arithmetic on ``event_id`` spreads brands, sources, ratings, phrases and
duplicate copies over all events, so the work grows with the table.  No row is
dropped: the weekly spike of the focus brand comes from moving three quarters of its
earlier reviews into the newest week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from avisgrid import schemas
from avisgrid.functions.text import quoted

BRANDS = ("abritel", "airbnb", "booking")
SOURCES = ("trustpilot", "google_play", "app_store")

PHRASES = (
    None,
    "   ",
    "(sans commentaire)",
    "N/A",
    "ko!",
    "👍👍👍👍👍👍 !!!",
    "oui oui",
    "superbe",
    "rien à dire",
    "Deux débits pour un seul séjour : prélevé deux fois, toujours aucun remboursement",
    "Le logement est devenu indisponible, réservation annulée à la dernière minute",
    "Les tarifs sortent en dollars alors que je navigue depuis Lyon",
    "Trois appels à un SAV injoignable, deux courriels, aucune réponse",
    "Je craignais le pire mais ce n'est pas une arnaque, je suis ravi du séjour",
    "Une arnaque, et un accueil honteux",
    "Paiement bloqué par 3D Secure et Stripe, via PayPal",
    "Paiement refusé, carte refusée",
    "Photos trompeuses, annonce non conforme à la description",
    "Hôte ne répond pas, aucun message",
    "Je suis propriétaire et mon annonce ne se publie plus depuis hier",
    "Personnel aimable et quartier calme",
    "Honteux et inadmissible, aucun remboursement de la caution",
    "Great stay, not complicated at all",
    "Refund denied, customer service unreachable",
)
VENDOR_REPLY = "Merci pour votre retour"

NEWEST_WEEK = "2024-01-29"
COLLECTED_AT = "2024-02-05 06:00:00"
OLDER_COLLECTED_AT = "2024-02-04 06:00:00"
AS_OF = "2024-02-10 00:00:00"


def pick(values: tuple, index: Column) -> Column:
    """Value number ``index`` (from 0) of a literal list."""
    return F.element_at(F.expr(listed(values)), index.cast("int") + 1)


def div(number: Column, by: int) -> Column:
    """Whole-number division."""
    return F.call_function("div", number, F.lit(by))


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def listed(values: tuple) -> str:
    return f"array({', '.join(quoted(v) for v in values)})"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per event, with the ``event_id`` it comes from."""
    posted = events(spark, sf_dir).selectExpr(
        "event_id",
        "user_id",
        "CAST(ts AS TIMESTAMP) + INTERVAL 5 DAYS AS posted",
        f"date_diff(DATE '{NEWEST_WEEK}', to_date(date_trunc('week', posted))) AS days_back",
    )
    dated = posted.selectExpr(
        "event_id",
        "CAST(event_id AS STRING) AS source_review_id",
        f"element_at({listed(BRANDS)}, CAST(event_id % 3 AS INT) + 1) AS brand_code",
        f"element_at({listed(SOURCES)}, CAST(event_id div 9 % 3 AS INT) + 1) AS source_code",
        """posted + make_dt_interval(CASE WHEN event_id % 3 = 0 AND event_id div 72 % 4 != 0
               AND days_back > 0 THEN days_back ELSE 0 END) AS review_date""",
        """CAST(CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 0
               ELSE event_id * 7 % 5 + 1 END AS INT) AS rating""",
        f"element_at({listed(PHRASES)}, CAST(event_id div 3 % 24 AS INT) + 1) AS text",
        "concat('u', user_id) AS author_handle",
        "IF(source_code != 'trustpilot', concat('1.', event_id % 7), NULL) AS app_version",
        f"IF(event_id % 4 = 0, {quoted(VENDOR_REPLY)}, NULL) AS vendor_response",
    )
    return dated.selectExpr(
        "*",
        """IF(event_id % 4 = 0, review_date + make_dt_interval(CAST(event_id % 9 - 1 AS INT)), NULL)
               AS vendor_response_at""",
    )


def landed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews as collected, plus an older copy of every tenth one."""
    copies = reviews(spark, sf_dir).selectExpr(
        "*", "explode(IF(event_id % 10 = 0, array(false, true), array(false))) AS older"
    )
    collected = {
        "rating": "IF(older, 5, rating) AS rating",
        "collected_at": f"""IF(older, TIMESTAMP '{OLDER_COLLECTED_AT}', TIMESTAMP '{COLLECTED_AT}')
               AS collected_at""",
    }
    return copies.selectExpr(*[collected.get(c, c) for c in schemas.LANDED.fieldNames()])


def arrived_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed reviews of one run in order of arrival, with repeated deliveries.

    Every tenth review is delivered again on a later page, under the next brand.
    """
    eid = F.col("event_id")
    copies = F.when(eid % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    again = F.col("copy") == 1
    return (
        reviews(spark, sf_dir)
        .withColumn("copy", F.explode(copies))
        .withColumns(
            {
                "brand_code": F.when(again, pick(BRANDS, (eid + 1) % 3)).otherwise(
                    F.col("brand_code")
                ),
                "arrival_page": div(eid, EVENTS_PER_PAGE) + F.col("copy") * 1_000_000_000,
                "arrival_pos": (eid % EVENTS_PER_PAGE).cast("int"),
            }
        )
        .drop("copy", "event_id")
    )


# --- payloads as the sources deliver them -----------------------------------
#
# 450 consecutive events make one page per brand with about 50 reviews.  Faults are
# spread by event number: missing ids, unreadable dates, missing ratings, blank bodies.

EVENTS_PER_PAGE = 450


def _pages(rows: DataFrame, entry: Column) -> DataFrame:
    """Entries gathered to one list per brand and page, in event order."""
    return (
        rows.withColumn("arrival_page", div(F.col("event_id"), EVENTS_PER_PAGE))
        .select("brand_code", "arrival_page", F.struct("event_id", entry.alias("e")).alias("x"))
        .groupBy("brand_code", "arrival_page")
        .agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["e"]).alias("entries"))
    )


def _title(eid: Column) -> Column:
    return F.when(eid % 5 == 0, "").when(eid % 5 == 1, "Avis.").otherwise(" Titre ")


def _id(eid: Column) -> Column:
    """The review id; missing or empty for some events."""
    return F.when(eid % 53 == 0, None).when(eid % 59 == 0, "").otherwise(eid.cast("string"))


def _of_source(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    return reviews(spark, sf_dir).where(F.col("source_code") == source)


def app_store_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")

    def label(value: Column) -> Column:
        return F.struct(value.alias("label"))

    local = F.date_format(F.col("review_date") - F.expr("INTERVAL 7 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    updated = (
        F.when(eid % 101 == 0, "not a date")
        .when(eid % 103 == 0, "")
        .otherwise(F.concat(local, F.lit("-07:00")))
    )
    entry = F.struct(
        F.when(F.col("rating").isNotNull(), label(F.col("rating").cast("string"))).alias("im:rating"),
        label(updated).alias("updated"),
        label(_id(eid)).alias("id"),
        label(_title(eid)).alias("title"),
        label(F.col("text")).alias("content"),
        F.struct(label(F.col("author_handle")).alias("name")).alias("author"),
        label(F.col("app_version")).alias("im:version"),
    )
    pages = _pages(_of_source(spark, sf_dir, "app_store"), entry)
    feed = F.struct(F.struct(F.col("entries").alias("entry")).alias("feed"))
    return pages.select("brand_code", "arrival_page", F.to_json(feed).alias("payload"))


def google_play_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")

    def naive(value: Column) -> Column:
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")

    entry = F.struct(
        _id(eid).alias("reviewId"),
        naive(F.col("review_date")).alias("at"),
        F.col("rating").alias("score"),
        F.col("text").alias("content"),
        F.when(eid % 47 == 0, "").otherwise(F.col("author_handle")).alias("userName"),
        F.when(eid % 43 == 0, "").otherwise(F.col("app_version")).alias("reviewCreatedVersion"),
        F.coalesce("vendor_response", F.lit("")).alias("replyContent"),
        naive(F.col("vendor_response_at")).alias("repliedAt"),
    )
    pages = _pages(_of_source(spark, sf_dir, "google_play"), entry)
    return pages.select("brand_code", "arrival_page", F.to_json("entries").alias("payload"))


def trustpilot_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages of the test tables with the page state appended.

    Pages without reviews stay without state, and every page with reviews comes a second
    time with its state cut short: both must give no rows.
    """
    eid = F.col("event_id")

    def zulu(value: Column) -> Column:
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    reply = F.struct(
        F.col("vendor_response").alias("message"), zulu(F.col("vendor_response_at")).alias("publishedDate")
    )
    entry = F.struct(
        _id(eid).alias("id"),
        # -1 is replaced by a written null below; a NULL rating leaves the field out.
        F.when(eid % 83 == 0, -1).otherwise(F.col("rating")).alias("rating"),
        _title(eid).alias("title"),
        F.col("text").alias("text"),
        F.struct(
            F.when(eid % 101 == 0, "not a date").otherwise(zulu(F.col("review_date"))).alias("publishedDate")
        ).alias("dates"),
        F.when(eid % 47 != 0, F.struct(F.col("author_handle").alias("displayName"))).alias("consumer"),
        F.when(F.col("vendor_response").isNotNull(), reply).alias("reply"),
    )
    state = F.struct(
        F.struct(F.struct(F.col("entries").alias("reviews")).alias("pageProps")).alias("props")
    )
    json = F.replace(
        F.to_json(state), F.lit('"rating":-1'), F.lit('"rating":null')
    )
    pages = _pages(_of_source(spark, sf_dir, "trustpilot"), entry).select(
        "brand_code", "arrival_page", json.alias("state")
    )
    shells = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").alias("arrival_page"), "html"
    )
    copies = F.when(F.col("state").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(
        F.array(F.lit(True))
    )
    document = F.when(F.col("whole"), F.col("state")).otherwise(
        F.substr("state", F.lit(1), F.char_length("state") - 3)
    )
    script = F.concat(
        F.lit('<script id="__NEXT_DATA__" type="application/json">'), document, F.lit("</script>")
    )
    return (
        pages.join(shells, "arrival_page", "full")
        .withColumn("whole", F.explode(copies))
        .select(
            "brand_code",
            "arrival_page",
            F.concat(F.coalesce("html", F.lit("")), F.coalesce(script, F.lit(""))).alias("payload"),
        )
    )


def payloads(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Payload frames per source, in the order the sources are read."""
    return {
        "google_play": google_play_payloads(spark, sf_dir),
        "app_store": app_store_payloads(spark, sf_dir),
        "trustpilot": trustpilot_payloads(spark, sf_dir),
    }


# --- second-pass model: replies by number -----------------------------------

REPLIES = (
    '{"confidence": 0.72, "category": "communication_hote"}',
    'Je dirais {"category": "qualite_annonces", "confidence": 0.55}, sans certitude.',
    '{"category": "meteo", "confidence": 0.8}',
    "je ne sais pas",
    '{"category" "app_fr"}',
    '{"category": "app_fr", "confidence": 3}',
    '{"category": "qualite_annonces", "confidence": -1}',
    '{"category": "communication_hote"}',
    '{"category": "app_fr"} {"category": "service_client"}',
    '[{"category": "app_fr", "confidence": 0.5}]',
    '{"category": "non_classe", "confidence": 0.3}',
    '{"category": "fiabilite_reservations", "confidence": "0.25"}',
    '{"category": "parcours_paiement", "confidence": "haute"}',
    None,
    "",
    '  {"category": "transparence_financiere", "confidence": true}  ',
)


def model_replies(chosen: DataFrame) -> DataFrame:
    """A stored reply per candidate, chosen by the number in its id."""
    number = div(F.col("source_review_id").cast("bigint"), 72)
    return chosen.select(
        "source_review_id", "source_code", pick(REPLIES, number % len(REPLIES)).alias("reply")
    )


def scripted_scorer(prompts):
    """Stands in for a model: one fixed reply per known review text.

    Batches fail in turn: one reply short, one too many, an error; single prompts are answered.
    """
    import pandas as pd

    def answer(prompt: str) -> str | None:
        if "oui oui" in prompt:
            return REPLIES[0]
        if "ravi du séjour" in prompt:
            return REPLIES[1]
        if "quartier calme" in prompt:
            raise TimeoutError("no answer")
        return REPLIES[3]

    if len(prompts) > 1:
        if len(prompts) % 3 == 2:
            raise TimeoutError("no answer to a batch")
        return pd.Series([REPLIES[0]] * (len(prompts) + (1 if len(prompts) % 3 else -1)))
    return pd.Series([answer(p) for p in prompts], index=prompts.index, dtype=object)
