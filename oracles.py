"""DuckDB statements that state the expected result of every query.

Written from the rules, not from the Spark code: they share the word lists and fixed
texts with the package, nothing else.
"""

from __future__ import annotations

from avisgrid.functions import taxonomy as tx
from avisgrid.sources import fixture as fx

# --- shared pieces ----------------------------------------------------------


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def words(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


# White space as Python's str.strip() sees it, spelled with code points.
SPACES = " || ".join(
    f"chr({c})"
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
SPACE_RE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NEGATION = tx.NEGATION_PATTERN.replace(r"\s", SPACE_RE).replace("'", "''")


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def unnegated(x: str) -> str:
    return f"regexp_replace({x}, '{NEGATION}', '', 'g')"


def n_hits(x: str, keywords) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {lit(k)}) AS INT)" for k in keywords) + ")"


def quality(text: str) -> str:
    s = strip(text)
    letters = rf"regexp_replace({s}, '[^\p{{L}}\p{{Nl}}\p{{No}}]+', '', 'g')"
    n_words = rf"len(regexp_extract_all({fold(s)}, '[\p{{L}}\p{{N}}_]+'))"
    return f"""CASE
        WHEN {text} IS NULL OR {s} = '' THEN 'vide'
        WHEN lower({s}) IN {words(tx.PLACEHOLDER_TEXTS)} THEN 'placeholder'
        WHEN length({s}) < 5 THEN 'trop_court'
        WHEN length({letters}) < 3 THEN 'non_textuel'
        WHEN {n_words} < 2 THEN 'trop_court'
        WHEN {fold(s)} IN {words(tx.GENERIC_PHRASES)} THEN 'generique_non_actionnable'
        END"""


CATEGORIES = list(tx.CATEGORY_KEYWORDS)


def category_counts(searched: str) -> str:
    return ",\n".join(
        f"coalesce({n_hits(searched, kws)}, 0) AS n_{c}" for c, kws in tx.CATEGORY_KEYWORDS.items()
    )


TOP = "greatest(" + ", ".join(f"n_{c}" for c in CATEGORIES) + ")"
CATEGORY = (
    f"CASE WHEN {TOP} = 0 THEN 'non_classe' "
    + " ".join(f"WHEN n_{c} = {TOP} THEN '{c}'" for c in CATEGORIES)
    + " END"
)

# The fixture: reviews from events (see FIXTURES.md, part B).
FIXTURE = f"""
posted AS (
    SELECT event_id AS eid, user_id, ts + INTERVAL 5 DAY AS posted_at,
           CAST(date_trunc('week', ts + INTERVAL 5 DAY) AS DATE) AS monday
    FROM events
),
rev0 AS (
    SELECT eid,
           CAST(eid AS VARCHAR) AS source_review_id,
           {arr(fx.BRANDS)}[eid % 3 + 1] AS brand_code,
           {arr(fx.SOURCES)}[(eid // 9) % 3 + 1] AS source_code,
           CASE WHEN eid % 3 = 0 AND (eid // 72) % 4 <> 0 AND monday < DATE '2024-01-29'
                THEN posted_at + to_days(CAST(DATE '2024-01-29' - monday AS INTEGER))
                ELSE posted_at END AS review_date,
           CAST(CASE WHEN eid % 97 = 0 THEN NULL WHEN eid % 89 = 0 THEN 0
                     ELSE (eid * 7) % 5 + 1 END AS INTEGER) AS rating,
           {arr(fx.PHRASES)}[(eid // 3) % 24 + 1] AS text,
           'u' || user_id AS author_handle,
           CASE WHEN (eid // 9) % 3 <> 0 THEN '1.' || (eid % 7) END AS app_version,
           CASE WHEN eid % 4 = 0 THEN {lit(fx.VENDOR_REPLY)} END AS vendor_response
    FROM posted
),
rev AS (
    SELECT *, CASE WHEN eid % 4 = 0
                   THEN review_date + to_days(CAST(eid % 9 - 1 AS INTEGER)) END AS vendor_response_at
    FROM rev0
)"""

LANDED = (
    FIXTURE
    + """,
landed AS (
    SELECT source_review_id, brand_code, source_code, review_date, rating, text, author_handle,
           app_version, vendor_response, vendor_response_at,
           TIMESTAMP '2024-02-05 06:00:00' AS collected_at
    FROM rev
    UNION ALL
    SELECT source_review_id, brand_code, source_code, review_date, 5, text, author_handle,
           app_version, vendor_response, vendor_response_at, TIMESTAMP '2024-02-04 06:00:00'
    FROM rev WHERE eid % 10 = 0
)"""
)


def refined_ctes(source: str, out: str) -> str:
    """Text classes of a table with ``text`` and ``rating``."""
    return f""",
{out}_n AS (SELECT *, {fold("text")} AS norm FROM {source}),
{out}_s AS (SELECT *, {unnegated("norm")} AS searched FROM {out}_n),
{out}_c AS (
    SELECT *, {category_counts("searched")},
           coalesce({n_hits("norm", tx.SEVERITY_KEYWORDS)}, 0) AS n_sev,
           {quality("text")} AS exclusion_reason
    FROM {out}_s
),
{out}_k AS (
    SELECT *, {CATEGORY} AS category_code,
           exclusion_reason IS NULL AS is_exploitable,
           CASE WHEN text IS NULL OR {strip("text")} = '' THEN 'indetermine'
                WHEN {" OR ".join(f"contains(norm, {lit(p)})" for p in tx.OWNER_PATTERNS)}
                THEN 'proprietaire' ELSE 'locataire' END AS persona_code,
           CASE WHEN coalesce(rating, 0) = 0 THEN 0.0::DOUBLE
                ELSE greatest(0.0, least(1.0, (5 - rating) / 4.0::DOUBLE)) END AS severity_rating_score,
           least(1.0::DOUBLE, n_sev / 2.0::DOUBLE) AS severity_text_score
    FROM {out}_c
),
{out} AS (
    SELECT *, CASE WHEN severity_text_score >= 0.5 THEN 'high'
                   WHEN rating = 1 THEN 'high'
                   WHEN rating = 2 AND category_code IN {words(tx.ESCALATED_CATEGORIES)} THEN 'high'
                   WHEN rating = 2 THEN 'medium' ELSE 'low' END AS severity_code
    FROM {out}_k
)"""


REFINED = LANDED + refined_ctes("landed", "refined")

RAW = (
    REFINED
    + """,
raw AS (
    SELECT source_review_id, source_code, brand_code, review_date, rating, text, author_handle,
           app_version, vendor_response, vendor_response_at, collected_at, is_exploitable,
           exclusion_reason, category_code, 'heuristic' AS category_source, persona_code,
           severity_code, severity_rating_score, severity_text_score,
           TIMESTAMP '2024-02-05 07:00:00' AS classified_at
    FROM refined
)"""
)


def staged_ctes(source: str) -> str:
    return f""",
stg AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY source_code, source_review_id
                                     ORDER BY collected_at DESC NULLS FIRST) AS rn,
               CASE WHEN vendor_response_at IS NOT NULL
                    THEN CAST(CAST(vendor_response_at AS DATE) - CAST(review_date AS DATE) AS INTEGER)
                    END AS response_latency_days,
               vendor_response IS NOT NULL AS vendor_responded
        FROM {source}) WHERE rn = 1
)"""


# The reference tables.
SEEDS = """,
brands(id, code, label, is_focus) AS (VALUES
    (1, 'abritel', 'Abritel', true), (2, 'airbnb', 'Airbnb', false),
    (3, 'booking', 'Booking', false)),
sources(id, code, label, type, url) AS (VALUES
    (1, 'trustpilot', 'Trustpilot', 'web', 'https://fr.trustpilot.com'),
    (2, 'google_play', 'Google Play', 'mobile', 'https://play.google.com'),
    (3, 'app_store', 'App Store', 'mobile', 'https://apps.apple.com')),
categories(id, code, label, is_critical) AS (VALUES
    (1, 'app_fr', 'Localisation / Langue', false),
    (2, 'transparence_financiere', 'Transparence financière', true),
    (3, 'fiabilite_reservations', 'Fiabilité réservations', true),
    (4, 'service_client', 'Service client', true),
    (5, 'qualite_annonces', 'Qualité des annonces', false),
    (6, 'parcours_paiement', 'Parcours paiement', true),
    (7, 'communication_hote', 'Communication hôte', false),
    (8, 'non_classe', 'Non classé', false)),
severities(id, code, label, rank) AS (VALUES
    (1, 'low', 'Basse', 1), (2, 'medium', 'Moyenne', 2), (3, 'high', 'Haute', 3)),
personas(id, code, label) AS (VALUES
    (1, 'locataire', 'Locataire'), (2, 'proprietaire', 'Propriétaire'),
    (3, 'indetermine', 'Indéterminé')),
statuses(id, code, label, is_terminal) AS (VALUES
    (1, 'open', 'Ouvert', false), (2, 'in_progress', 'En cours', false),
    (3, 'resolved', 'Résolu', true), (4, 'closed', 'Clos', true))"""


def star_ctes(raw: str) -> str:
    return (
        staged_ctes(raw)
        + SEEDS
        + """,
fact AS (
    SELECT row_number() OVER (ORDER BY review_date NULLS LAST, source_review_id NULLS LAST,
                              source_code NULLS LAST) AS id,
           sha256(coalesce(source_code, chr(30)) || chr(31) || coalesce(source_review_id, chr(30)))
               AS review_key,
           stg.*, b.id AS brand_id, s.id AS source_id, c.id AS category_id, p.id AS persona_id,
           v.id AS severity_id,
           CAST(strftime(review_date, '%Y%m%d') AS INTEGER) AS date_id
    FROM stg
    LEFT JOIN brands b ON b.code = stg.brand_code
    LEFT JOIN sources s ON s.code = stg.source_code
    LEFT JOIN categories c ON c.code = stg.category_code
    LEFT JOIN personas p ON p.code = stg.persona_code
    LEFT JOIN severities v ON v.code = stg.severity_code
),
cls AS (
    SELECT row_number() OVER (ORDER BY f.id) AS id, f.id AS review_id, f.review_key,
           b.category_id, b.severity_id, b.severity_rating_score, b.severity_text_score,
           1.0::DOUBLE AS confidence, coalesce(b.category_source, 'heuristic') AS method,
           b.classified_at
    FROM fact f JOIN fact b ON b.source_review_id = f.source_review_id
                           AND b.source_id = f.source_id
),
placed AS (
    SELECT * FROM fact WHERE source_id IS NOT NULL AND source_review_id IS NOT NULL
),
joined AS (
    SELECT *, severity_code AS sev_code, category_id AS cid
    FROM placed WHERE is_exploitable AND severity_id IS NOT NULL
),
urgent AS (
    SELECT * FROM joined
    WHERE sev_code = 'high' AND cid IN (SELECT id FROM categories WHERE is_critical)
),
tck AS (
    SELECT row_number() OVER (ORDER BY collected_at DESC NULLS FIRST, id) AS id, id AS review_id,
           review_key, NULL::VARCHAR AS external_ticket_id, 1 AS status_id, severity_id,
           'csv' AS channel, NULL::VARCHAR AS assignee, collected_at AS created_at,
           NULL::TIMESTAMP AS resolved_at, NULL::VARCHAR AS resolution_notes
    FROM urgent
)"""
    )


STAR = RAW + star_ctes("raw")


NUMBER = "CAST(source_review_id AS BIGINT)"


def runs_ctes(names: tuple[str, ...]) -> str:
    """The runs of the incremental queries; of equal times the later run's version stays."""
    kept = {
        "r1": f"SELECT *, 'r1' AS run_id FROM raw WHERE {NUMBER} % 7 <> 0",
        "r2": f"""SELECT * REPLACE (CASE WHEN {NUMBER} % 10 = 0 THEN text || ' bis' ELSE text END AS text),
                         'r2' FROM raw WHERE {NUMBER} % 10 = 0 OR {NUMBER} % 7 = 0""",
        "r3": f"""SELECT * REPLACE (review_date + INTERVAL 40 DAY AS review_date, CAST(2 AS INTEGER) AS rating,
                                   collected_at + INTERVAL 1 DAY AS collected_at),
                         'r3' FROM raw WHERE {NUMBER} % 15 = 0""",
    }
    union = " UNION ALL ".join(kept[n] for n in names)
    return f""",
runs AS (
    SELECT * EXCLUDE (run_id) FROM ({union})
    QUALIFY row_number() OVER (PARTITION BY source_code, source_review_id, collected_at
                               ORDER BY run_id DESC) = 1
)"""


RUNS = RAW + runs_ctes(("r1", "r2", "r3")) + star_ctes("runs")
WITHOUT_SECOND = RAW + runs_ctes(("r1", "r3")) + star_ctes("runs")


def dec(x: str, digits: int) -> str:
    """Rounded half away from zero in decimal arithmetic, as double."""
    return f"CAST(round(CAST({x} AS DECIMAL(28, 10)), {digits}) AS DOUBLE)"


def label(table: str, key: str) -> str:
    """The label that a key has in a reference table."""
    return f"(SELECT label FROM {table} WHERE id = {key})"


DAILY = """,
daily AS (
    SELECT n.date_id, n.brand_id, b.code AS brand_code, b.label AS brand_label, b.is_focus,
           n.seen AS total_reviews, n.stars / n.rated AS avg_rating, n.bad / n.seen AS share_critical
    FROM (SELECT date_id, brand_id, count(*) AS seen, sum(rating) AS stars, count(rating) AS rated,
                 count_if(sev_code = 'high') AS bad
          FROM joined GROUP BY date_id, brand_id) n, brands b
    WHERE b.id = n.brand_id
),
rivals AS (
    SELECT date_id, list_avg(list(avg_rating)) AS competitor_avg_rating
    FROM daily WHERE NOT is_focus GROUP BY date_id
)"""

CELLS = """,
cells AS (
    SELECT date_id, brand_id, cid AS category_id, persona_id, count(*) AS review_count,
           CAST(sum(rating) AS BIGINT) AS rating_sum, count(rating) AS rating_count,
           count(*) FILTER (sev_code = 'high') AS high_count
    FROM joined GROUP BY date_id, brand_id, cid, persona_id
),
focus AS (
    SELECT category_id, sum(review_count) / count(*) AS focus_volume
    FROM cells WHERE brand_id IN (SELECT id FROM brands WHERE is_focus)
    GROUP BY category_id
)"""

VOICE = f"""
    SELECT date_id, {label("brands", "brand_id")} AS brand_label,
           {label("categories", "category_id")} AS category_label,
           {label("personas", "persona_id")} AS persona_label, review_count,
           {dec("rating_sum / rating_count", 2)} AS avg_rating,
           {dec("high_count / review_count", 3)} AS share_high_severity,
           {dec("review_count / nullif(base, 0)", 2)} AS ratio_vs_abritel
    FROM (SELECT *, avg(review_count) FILTER (brand_id IN (SELECT id FROM brands WHERE is_focus))
                        OVER (PARTITION BY category_id) AS base FROM cells)
    WHERE brand_id IS NOT NULL AND category_id IS NOT NULL AND persona_id IS NOT NULL"""

FACTS = """SELECT id, review_key, source_review_id, source_id, brand_id, date_id, review_date,
                  persona_id, rating, text, 'fr' AS language, author_handle, app_version,
                  vendor_responded, vendor_response_at, response_latency_days, is_exploitable,
                  exclusion_reason, collected_at FROM fact"""

SYNTHESIS = f"""
        SELECT date_id, brand_label, total_reviews, {dec("avg_rating", 2)} AS avg_rating,
               {dec("share_critical", 3)} AS share_critical,
               coalesce(solved, 0.0) AS ticket_resolution_rate,
               CASE WHEN is_focus THEN {dec("avg_rating - competitor_avg_rating", 2)} END
                   AS gap_vs_competitors
        FROM daily LEFT JOIN rivals USING (date_id)
        LEFT JOIN (SELECT date_id, avg(CASE WHEN status_id IN
                              (SELECT id FROM statuses WHERE is_terminal) THEN 1 ELSE 0 END) AS solved
                   FROM tck JOIN fact ON fact.id = tck.review_id GROUP BY date_id) USING (date_id)"""

# The newest weeks of a pair are one list, newest first: place 1 is now, places 2 to 5 are before.
WEEKLY = f""",
weekly AS (
    SELECT {label("brands", "brand_id")} AS brand, {label("categories", "cid")} AS category,
           week_start, n_high, n_total
    FROM (SELECT brand_id, cid, date_trunc('week', review_date)::DATE AS week_start,
                 count(*) FILTER (sev_code = 'high') AS n_high, count(*) AS n_total
          FROM joined WHERE brand_id IS NOT NULL AND cid IS NOT NULL GROUP BY ALL)
),
history AS (
    SELECT brand, category,
           list({{'at': week_start, 'high': n_high, 'all': n_total}}
                ORDER BY week_start DESC NULLS FIRST)[1:5] AS w
    FROM weekly GROUP BY brand, category
),
weeks AS (
    SELECT brand, category, w[rn]['at'] AS week_start, w[rn]['high'] AS n_high,
           w[rn]['all'] AS n_total, rn
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS rn FROM history)
),
spikes AS (
    SELECT brand, category, w[1]['at'] AS current_week, w[1]['high'] AS current_high,
           list_avg([x['high'] for x in w[2:5]]) AS baseline_avg_high
    FROM history
    WHERE baseline_avg_high > 0 AND current_high >= greatest(5, 2 * baseline_avg_high)
)"""

OWNER = (
    "CASE category_code "
    + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in tx.OWNER_TEAMS.items())
    + " ELSE 'sav' END"
)


def numbered_text(prefix: str, n: str) -> str:
    return f"'{prefix}' || repeat('0', greatest(0, 4 - length(CAST({n} AS VARCHAR)))) || {n}"


CRITICAL = f""",
crit AS (
    SELECT id AS review_id, review_key, review_date AS occurred_at,
           {label("brands", "brand_id")} AS brand, {label("sources", "source_id")} AS source,
           {label("categories", "cid")} AS category, {label("severities", "severity_id")} AS severity,
           rating, substr(text, 1, 280) AS excerpt, category_code, sev_code AS severity_code
    FROM urgent WHERE brand_id IS NOT NULL
)"""

TICKETS = (
    CRITICAL
    + f""",
ranked AS (
    SELECT *, row_number() OVER (ORDER BY occurred_at DESC NULLS FIRST, review_id) AS n FROM crit
),
tickets AS (
    SELECT {numbered_text("TICK-", "n")} AS ticket_id, review_id, review_key, occurred_at, brand,
           source, category, severity, rating, 'open' AS status, {OWNER} AS owner_team, excerpt
    FROM ranked
)"""
)

# Reviews an earlier run has pushed: those with an even number.
KNOWN = """,
known AS (SELECT review_key FROM fact WHERE CAST(source_review_id AS BIGINT) % 2 = 0)"""

# Expected verdict per stored reply, worked out by hand (number, category, confidence).
VERDICTS = """,
expected(n, verdict_category, verdict_confidence) AS (VALUES
    (0, 'communication_hote', 0.72::DOUBLE), (1, 'qualite_annonces', 0.55), (2, NULL, NULL), (3, NULL, NULL),
    (4, NULL, NULL), (5, 'app_fr', 1.0), (6, 'qualite_annonces', 0.0),
    (7, 'communication_hote', 0.5), (8, NULL, NULL), (9, NULL, NULL), (10, 'non_classe', 0.3),
    (11, 'fiabilite_reservations', 0.25), (12, 'parcours_paiement', 0.5), (13, NULL, NULL),
    (14, NULL, NULL), (15, 'transparence_financiere', 1.0)),
cand AS (
    SELECT * FROM stg WHERE is_exploitable AND category_code = 'non_classe'
),
verdicts AS (
    SELECT c.source_review_id, c.source_code, e.verdict_category, e.verdict_confidence
    FROM cand c JOIN expected e
      ON e.n = (CAST(c.source_review_id AS BIGINT) // 72) % 16
)"""

STAGED = RAW + staged_ctes("raw")


def sql(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip().lstrip(",") + "\n" + body.strip()


KEY = "source_code, source_review_id, collected_at"

# Title, body and the text they join to, for payload rows of the fixture.
TITLED = f"""
    CASE WHEN eid % 5 = 0 THEN '' WHEN eid % 5 = 1 THEN 'Avis.' ELSE 'Titre' END AS title,
    coalesce({strip("text")}, '') AS body"""
JOINED = """CASE WHEN title <> '' THEN trim(title || '. ' || body, '. ')
                 WHEN body <> '' THEN body ELSE '(sans commentaire)' END"""


def iso(ts: str) -> str:
    micros = f"CASE WHEN microsecond({ts}) % 1000000 <> 0 THEN strftime({ts}, '.%f') ELSE '' END"
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || {micros} || '+00:00'"


def given_id(fallback: str) -> str:
    return f"""CASE WHEN eid % 53 = 0 OR eid % 59 = 0 THEN {fallback}
                    ELSE CAST(eid AS VARCHAR) END AS source_review_id"""


APP_STORE = f""",
app AS (
    SELECT {given_id("'as_' || " + iso("review_date"))}, brand_code, source_code, review_date,
           rating, {JOINED} AS text, author_handle, app_version,
           CAST(NULL AS VARCHAR) AS vendor_response, CAST(NULL AS TIMESTAMP) AS vendor_response_at,
           eid
    FROM (SELECT *, {TITLED} FROM rev WHERE source_code = 'app_store')
    WHERE rating IS NOT NULL AND eid % 101 <> 0 AND eid % 103 <> 0
)"""

TRUSTPILOT = f""",
trust AS (
    SELECT {given_id("'tp_' || " + iso("ms"))}, brand_code, source_code, ms AS review_date,
           CASE WHEN eid % 83 = 0 THEN NULL ELSE coalesce(rating, 0) END AS rating,
           {JOINED} AS text, CASE WHEN eid % 47 <> 0 THEN author_handle END AS author_handle,
           CAST(NULL AS VARCHAR) AS app_version, vendor_response,
           date_trunc('millisecond', vendor_response_at) AS vendor_response_at, eid
    FROM (SELECT *, date_trunc('millisecond', review_date) AS ms, {TITLED}
          FROM rev WHERE source_code = 'trustpilot')
    WHERE eid % 101 <> 0
)"""

GOOGLE_PLAY = f""",
play AS (
    SELECT {given_id("'gp_' || strftime(review_date, '%Y-%m-%dT%H:%M:%S.%f')")}, brand_code,
           source_code, review_date, rating,
           coalesce(nullif({strip("text")}, ''), '(sans commentaire)') AS text,
           CASE WHEN eid % 47 <> 0 THEN author_handle END AS author_handle,
           CASE WHEN eid % 43 <> 0 THEN app_version END AS app_version,
           vendor_response, vendor_response_at, eid
    FROM rev WHERE source_code = 'google_play'
)"""

# Paris was one hour ahead of UTC in the winter weeks of the fixture.
IN_WINDOW = (
    "CAST(review_date + INTERVAL 1 HOUR AS DATE) >= DATE '2024-02-10' - INTERVAL 30 DAY"
)

ARRIVED = (
    FIXTURE
    + f""",
arrived AS (
    SELECT *, eid // 450 AS arrival_page, eid % 450 AS arrival_pos FROM rev
    UNION ALL
    SELECT * REPLACE ({arr(fx.BRANDS)}[(eid + 1) % 3 + 1] AS brand_code),
           eid // 450 + 1000000000, eid % 450
    FROM rev WHERE eid % 10 = 0
)"""
)

FAULTY = (
    RAW
    + """,
faulty AS (
    SELECT * REPLACE (
        CASE WHEN n % 11 = 0 THEN NULL WHEN n % 13 = 0 THEN 'forum' ELSE source_code END
            AS source_code,
        CASE WHEN n % 17 = 0 THEN 'autre' ELSE brand_code END AS brand_code,
        CASE WHEN n % 19 <> 0 THEN review_date END AS review_date,
        CASE WHEN n % 23 = 0 THEN 'urgent' ELSE severity_code END AS severity_code,
        CASE WHEN n % 29 <> 0 THEN category_source END AS category_source)
    FROM (SELECT *, CAST(source_review_id AS BIGINT) AS n FROM raw)
)"""
)


def null_check(table: str, source: str, column: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, 'not_null' AS check_name, '{column}' AS column_name, "
        f"count(*) FILTER ({column} IS NULL) AS failures FROM {source}"
    )


def accepted_check(table: str, source: str, column: str, allowed) -> str:
    return (
        f"SELECT '{table}' AS table_name, 'accepted_values' AS check_name, "
        f"'{column}' AS column_name, "
        f"count(*) FILTER ({column} NOT IN {words(allowed)}) AS failures FROM {source}"
    )


def unique_check(table: str, source: str, column: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, 'unique' AS check_name, '{column}' AS column_name, "
        f"count(*) AS failures FROM (SELECT {column} FROM {source} WHERE {column} IS NOT NULL "
        f"GROUP BY {column} HAVING count(*) > 1)"
    )


RAW_NULLS = ("source_review_id", "source_code", "brand_code", "review_date", "is_exploitable")
RAW_ACCEPTED = {
    "source_code": ("trustpilot", "google_play", "app_store"),
    "brand_code": ("abritel", "airbnb", "booking"),
    "severity_code": ("low", "medium", "high"),
    "category_source": ("heuristic", "llm"),
}
DAYS = """,
days AS (
    SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id, CAST(d AS DATE) AS date
    FROM generate_series(DATE '2024-01-01', DATE '2026-12-31', INTERVAL 1 DAY) t(d)
)"""

NOT_NULL_TABLES = {
    "fact_reviews": ("fact", ("id", "source_id", "brand_id", "date_id", "is_exploitable")),
    "fact_classifications": ("cls", ("id", "review_id", "category_id", "severity_id")),
    "fact_tickets": ("tck", ("id", "review_id")),
    "dim_brand": ("brands", ("id", "code")),
    "dim_source": ("sources", ("id", "code")),
    "dim_category": ("categories", ("id", "code")),
    "dim_severity": ("severities", ("id", "code")),
    "dim_persona": ("personas", ("id", "code")),
    "dim_date": ("days", ("date_id",)),
}
UNIQUE_TABLES = {
    **{t: (src, ("id",)) for t, (src, _) in NOT_NULL_TABLES.items() if t.startswith("fact")},
    **{t: v for t, v in NOT_NULL_TABLES.items() if t.startswith("dim")},
}

REPORT = "\nUNION ALL ".join(
    [null_check("raw_reviews", "faulty", c) for c in RAW_NULLS]
    + [accepted_check("raw_reviews", "faulty", c, v) for c, v in RAW_ACCEPTED.items()]
    + [accepted_check("dim_severity", "severities", "code", ("low", "medium", "high"))]
    + [null_check(t, s, c) for t, (s, cols) in NOT_NULL_TABLES.items() for c in cols]
    + [unique_check(t, s, c) for t, (s, cols) in UNIQUE_TABLES.items() for c in cols]
)

RECAP = """
    SELECT csv_tickets, new_tickets, alerts,
           ':bell: *Avis clients — run terminé*' || chr(10)
           || '- tickets critiques : ' || csv_tickets || chr(10)
           || '- dont nouveaux : ' || new_tickets || chr(10)
           || '- hausses de la semaine : ' || alerts AS message
    FROM (SELECT (SELECT count(*) FROM tickets) AS csv_tickets,
                 (SELECT count(*) FROM tickets
                  WHERE review_key NOT IN (SELECT review_key FROM known)) AS new_tickets,
                 (SELECT count(*) FROM spikes) AS alerts)"""

# The day of the daily run: all payloads in the window, unclassified texts scored.
DAY = (
    FIXTURE
    + APP_STORE
    + TRUSTPILOT
    + GOOGLE_PLAY
    + f""",
day AS (
    SELECT * EXCLUDE (eid), TIMESTAMP '2024-02-10 00:00:00' AS collected_at
    FROM (SELECT * FROM app UNION ALL SELECT * FROM trust UNION ALL SELECT * FROM play)
    WHERE {IN_WINDOW}
)"""
    + refined_ctes("day", "refined")
    + """,
raw AS (
    SELECT * REPLACE (
        CASE WHEN is_exploitable AND category_code = 'non_classe' AND contains(text, 'oui oui')
             THEN 'communication_hote'
             WHEN is_exploitable AND category_code = 'non_classe'
                  AND contains(text, 'ravi du séjour') THEN 'qualite_annonces'
             ELSE category_code END AS category_code),
        'heuristic' AS category_source, collected_at AS classified_at
    FROM refined
)"""
    + star_ctes("raw")
    + TICKETS
    + WEEKLY
    + """,
known AS (SELECT review_key FROM fact WHERE false)"""
)

REVIEW_COLUMNS = (
    "source_review_id, brand_code, source_code, review_date, rating, text, author_handle, "
    "app_version, vendor_response, vendor_response_at"
)


def choice(column: str) -> str:
    return f"json_object('select', json_object('name', {column}))"


PROPERTIES = f"""json_object(
    'ticket_id', json_object('title', json_array(json_object('text',
        json_object('content', ticket_id)))),
    'review_id', json_object('number', review_id),
    'brand', {choice("brand")}, 'source', {choice("source")},
    'category', {choice("category")}, 'severity', {choice("severity")},
    'rating', json_object('number', rating), 'status', {choice("status")},
    'owner_team', {choice("owner_team")},
    'occurred_at', json_object('date', json_object('start', strftime(occurred_at, '%Y-%m-%d'))),
    'excerpt', json_object('rich_text', json_array(json_object('text',
        json_object('content', substr(excerpt, 1, 1900))))))"""

PROMPT_LIST = "\n".join(f"- {c}: {d}" for c, d in tx.MODEL_CATEGORIES.items())
PROMPT_START = lit(tx.PROMPT_HEAD + PROMPT_LIST + tx.PROMPT_BEFORE_TEXT)

TEXT_KINDS = """
    SELECT 'document' AS kind, doc_id AS id, text FROM documents
    UNION ALL SELECT 'review', eid, text FROM rev"""

ORACLES: dict[str, str] = {
    # sources and landing
    "ingest_app_store": sql(FIXTURE + APP_STORE, f"SELECT {REVIEW_COLUMNS} FROM app"),
    "ingest_trustpilot": sql(FIXTURE + TRUSTPILOT, f"SELECT {REVIEW_COLUMNS} FROM trust"),
    "ingest_google_play": sql(FIXTURE + GOOGLE_PLAY, f"SELECT {REVIEW_COLUMNS} FROM play"),
    "rejected_pages": sql(
        FIXTURE,
        """SELECT source_code, outcome, count(*) AS n FROM (
               SELECT source_code,
                      CASE WHEN source_code = 'app_store' AND rating IS NULL THEN 'no_rating'
                           WHEN source_code = 'app_store' AND (eid % 101 = 0 OR eid % 103 = 0)
                             OR source_code = 'trustpilot' AND eid % 101 = 0 THEN 'no_date'
                           ELSE 'kept' END AS outcome
               FROM rev
               UNION ALL
               SELECT DISTINCT ON (brand_code, eid // 450) 'trustpilot', 'unreadable_page'
               FROM rev WHERE source_code = 'trustpilot'
               UNION ALL
               SELECT 'trustpilot', 'no_state' FROM pages
               WHERE page_id NOT IN (SELECT eid // 450 FROM rev WHERE source_code = 'trustpilot')
           ) GROUP BY source_code, outcome""",
    ),
    "fallback_review_id": f"""
        SELECT event_id,
               CASE WHEN event_id % 3 = 2 THEN CAST(event_id AS VARCHAR)
                    ELSE 'as_' || {iso("ts")} END AS app_store_id,
               CASE WHEN event_id % 3 = 2 THEN CAST(event_id AS VARCHAR)
                    ELSE 'tp_' || strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS trustpilot_id
        FROM events""",
    "parse_ts_utc": """
        SELECT event_id, CASE WHEN event_id % 8 <= 2 THEN date_trunc('second', ts)
                              WHEN event_id % 8 <= 4 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
                         END AS parsed
        FROM events""",
    # Summer time from 2024-03-31 01:00 to 2024-10-27 01:00 UTC.
    "paris_date": """
        SELECT event_id,
               CAST(t + CASE WHEN t >= TIMESTAMP '2024-03-31 01:00:00'
                               AND t < TIMESTAMP '2024-10-27 01:00:00'
                              THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS DATE) AS paris_date
        FROM (SELECT event_id, ts + to_days(CAST(event_id % 330 AS INTEGER)) AS t FROM events)""",
    "window_filter": sql(
        FIXTURE,
        f"SELECT source_review_id, source_code, review_date FROM rev WHERE {IN_WINDOW}",
    ),
    "join_title_body": sql(
        FIXTURE,
        f"""
        SELECT kind, id,
               CASE WHEN title <> '' AND trim(title || '. ' || body, '. ') <> ''
                    THEN trim(title || '. ' || body, '. ')
                    WHEN title = '' AND body <> '' THEN body
                    ELSE '(sans commentaire)' END AS text
        FROM (SELECT kind, id, coalesce({strip("text")}, '') AS body,
                     CASE WHEN id % 4 < 2 THEN '' WHEN id % 4 = 2 THEN '...' ELSE 'Avis' END AS title
              FROM ({TEXT_KINDS}))""",
    ),
    "cap_per_source_brand": sql(
        ARRIVED,
        """
        SELECT source_code, brand_code, source_review_id, arrival_page FROM (
            SELECT *, row_number() OVER (PARTITION BY source_code, brand_code
                ORDER BY arrival_page, arrival_pos, source_review_id) AS rn
            FROM arrived) WHERE rn <= 100""",
    ),
    "union_sources": sql(
        FIXTURE,
        """
        SELECT * EXCLUDE (eid) REPLACE (
                   CASE WHEN source_code <> 'app_store' THEN vendor_response END AS vendor_response,
                   CASE WHEN source_code <> 'app_store' THEN vendor_response_at END
                       AS vendor_response_at),
               TIMESTAMP '2024-02-10 00:00:00' AS collected_at
        FROM rev""",
    ),
    "dedup_keep_first": sql(
        ARRIVED,
        f"""
        SELECT source_code, source_review_id, brand_code, arrival_page FROM (
            SELECT *, row_number() OVER (PARTITION BY source_code, source_review_id
                ORDER BY list_position({arr(fx.BRANDS)}, brand_code), arrival_page, arrival_pos) AS rn
            FROM arrived) WHERE rn = 1""",
    ),
    "land_run": sql(
        FIXTURE + APP_STORE + TRUSTPILOT + GOOGLE_PLAY,
        f"""
        SELECT {REVIEW_COLUMNS}, TIMESTAMP '2024-02-10 00:00:00' AS collected_at
        FROM (SELECT * FROM app UNION ALL SELECT * FROM trust UNION ALL SELECT * FROM play)
        WHERE {IN_WINDOW}""",
    ),
    "bronze_roundtrip": sql(LANDED, "SELECT * FROM landed"),
    "latest_run_scan": sql(
        LANDED, "SELECT * FROM landed WHERE collected_at = TIMESTAMP '2024-02-05 06:00:00'"
    ),
    "raw_load": sql(RAW, "SELECT * FROM raw"),
    "seeds_typed": sql(
        FIXTURE + SEEDS,
        """
        SELECT r.brand_code, r.source_code, count(*) AS n_reviews, b.is_focus,
               s.id AS source_id, s.type, s.url
        FROM rev r JOIN brands b ON b.code = r.brand_code JOIN sources s ON s.code = r.source_code
        GROUP BY ALL""",
    ),
    # quality filter
    "quality_filter": sql(REFINED, f"SELECT {KEY}, is_exploitable, exclusion_reason FROM refined"),
    "quality_filter_documents": f"""
        SELECT doc_id, q IS NULL AS is_exploitable, q AS exclusion_reason
        FROM (SELECT doc_id, {quality("text")} AS q FROM documents)""",
    "quality_filter_conversations": f"""
        SELECT conv_id, turn, q IS NULL AS is_exploitable, q AS exclusion_reason
        FROM (SELECT conv_id, turn, {quality("text")} AS q FROM conversations)""",
    "quality_reason_counts": sql(
        REFINED,
        """SELECT coalesce(exclusion_reason, 'exploitable') AS reason, count(*) AS n_reviews
           FROM refined GROUP BY ALL""",
    ),
    # taxonomy
    "normalize_text": f"SELECT doc_id, {fold('text')} AS folded FROM documents",
    "strip_negation": sql(
        FIXTURE, f"SELECT kind, id, {unnegated(fold('text'))} AS searched FROM ({TEXT_KINDS})"
    ),
    "category_scores": sql(
        REFINED, f"SELECT {KEY}, {', '.join('n_' + c for c in CATEGORIES)} FROM refined"
    ),
    "category_scores_documents": f"""
        SELECT doc_id, {category_counts("s")}
        FROM (SELECT doc_id, {unnegated(fold("text"))} AS s FROM documents)""",
    "classify_category": sql(REFINED, f"SELECT {KEY}, category_code FROM refined"),
    "severity_scores": sql(
        REFINED, f"SELECT {KEY}, severity_rating_score, severity_text_score FROM refined"
    ),
    "classify_severity": sql(REFINED, f"SELECT {KEY}, severity_code FROM refined"),
    "classify_persona": sql(REFINED, f"SELECT {KEY}, persona_code FROM refined"),
    "refine_reviews": sql(RAW, "SELECT * FROM raw"),
    "refine_documents": sql(
        "docs AS (SELECT doc_id, text, CAST(doc_id % 6 AS INTEGER) AS rating FROM documents)"
        + refined_ctes("docs", "refined"),
        """SELECT doc_id, rating, exclusion_reason, persona_code, severity_text_score,
                  severity_rating_score, is_exploitable, category_code, severity_code
           FROM refined""",
    ),
    # second-pass model
    "model_candidates": sql(
        STAGED,
        """SELECT source_review_id, source_code, text FROM stg
           WHERE is_exploitable AND category_code = 'non_classe'""",
    ),
    "model_prompts": sql(
        STAGED,
        f"""SELECT source_review_id, source_code,
                   {PROMPT_START} || replace({strip("text")}, '\"\"\"', '\"')
                   || {lit(tx.PROMPT_AFTER_TEXT)} AS prompt
            FROM stg WHERE is_exploitable AND category_code = 'non_classe'""",
    ),
    # The scripted scorer answers two of the four unclassified phrases, one of them inside text.
    "model_scoring": sql(
        STAGED,
        """SELECT source_review_id, source_code,
                  CASE text WHEN 'oui oui' THEN 'communication_hote' ELSE 'qualite_annonces' END
                      AS verdict_category,
                  CASE text WHEN 'oui oui' THEN 0.72::DOUBLE ELSE 0.55 END AS verdict_confidence
           FROM stg WHERE text = 'oui oui' OR text LIKE '%ravi du séjour'
        """,
    ),
    "reclassify_reviews": sql(
        STAGED,
        """
        SELECT source_review_id, source_code,
               CASE WHEN text = 'oui oui' THEN 'communication_hote'
                    WHEN text LIKE '%ravi du séjour' THEN 'qualite_annonces'
                    ELSE category_code END AS category_code,
               CASE WHEN text = 'oui oui' OR text LIKE '%ravi du séjour' THEN 'llm'
                    ELSE category_source END AS category_source,
               severity_code
        FROM stg""",
    ),
    "parse_verdicts": sql(STAGED + VERDICTS, "SELECT * FROM verdicts"),
    "apply_verdicts": sql(
        STAGED + VERDICTS,
        """
        SELECT s.source_review_id, s.source_code,
               CASE WHEN v.verdict_category <> 'non_classe' THEN v.verdict_category
                    ELSE s.category_code END AS category_code,
               CASE WHEN v.verdict_category <> 'non_classe' THEN 'llm'
                    ELSE s.category_source END AS category_source,
               s.severity_code
        FROM stg s LEFT JOIN verdicts v USING (source_review_id, source_code)""",
    ),
    "verdict_stats": sql(
        STAGED + VERDICTS,
        """SELECT count(*) AS candidates,
                  count(*) FILTER (verdict_category <> 'non_classe') AS updated,
                  count(*) FILTER (coalesce(verdict_category, 'non_classe') = 'non_classe') AS skipped
           FROM verdicts""",
    ),
    "stored_verdict_stats": sql(
        STAGED,
        """SELECT count(*) AS candidates, count(*) FILTER (known) AS updated, count(*) FILTER (NOT known) AS skipped
           FROM (SELECT text = 'oui oui' OR text LIKE '%ravi du séjour' AS known
                 FROM stg WHERE is_exploitable AND category_code = 'non_classe')""",
    ),
    # staging and star
    "stg_latest_version": sql(
        STAGED,
        """SELECT source_review_id, source_code, brand_code, review_date, rating, text,
                  collected_at, severity_code FROM stg""",
    ),
    "multi_run_stage": sql(
        STAGED,
        """SELECT source_code, source_review_id, collected_at,
                  text || CASE WHEN CAST(source_review_id AS BIGINT) % 10 = 0 THEN ' bis' ELSE '' END
                      AS text
           FROM stg""",
    ),
    "incremental_month": sql(RUNS, FACTS),
    "incremental_reload": sql(WITHOUT_SECOND, FACTS),
    "incremental_versions": sql(
        RUNS,
        """SELECT review_key, collected_at, classified_at, review_date, brand_code, rating, category_code,
                  source_review_id, source_id, date_id, brand_id, category_id, persona_id, severity_id,
                  severity_code, is_exploitable FROM fact""",
    ),
    "incremental_direction": sql(WITHOUT_SECOND + DAILY, SYNTHESIS),
    "incremental_marketing": sql(RUNS + CELLS, VOICE),
    "response_latency": sql(
        STAGED,
        """SELECT source_review_id, source_code, response_latency_days, vendor_responded
           FROM stg""",
    ),
    "resolve_keys": sql(
        STAR,
        """SELECT review_key, source_review_id, date_id, brand_id, source_id, category_id,
                  persona_id, severity_id FROM fact""",
    ),
    "dim_all": sql(
        STAR,
        "\nUNION ALL ".join(
            f"""SELECT '{dim}' AS dimension, d.id, d.code, d.label, {detail} AS detail,
                       (SELECT count(*) FROM fact WHERE {key} = d.id) AS n_reviews
                FROM {table} d"""
            for dim, table, key, detail in (
                ("dim_brand", "brands", "brand_id", "CAST(d.is_focus AS VARCHAR)"),
                ("dim_source", "sources", "source_id", "d.type || '|' || d.url"),
                ("dim_category", "categories", "category_id", "CAST(d.is_critical AS VARCHAR)"),
                ("dim_severity", "severities", "severity_id", "CAST(d.rank AS VARCHAR)"),
                ("dim_persona", "personas", "persona_id", "''"),
                ("dim_ticket_status", "statuses", "-1", "CAST(d.is_terminal AS VARCHAR)"),
            )
        ),
    ),
    "dim_date": sql(
        FIXTURE + DAYS,
        """
        SELECT date_id, date, CAST(year(date) AS INTEGER) AS year,
               CAST(quarter(date) AS INTEGER) AS quarter, CAST(month(date) AS INTEGER) AS month,
               CAST(week(date) AS INTEGER) AS week, CAST(dayofweek(date) AS INTEGER) AS day_of_week,
               dayofweek(date) IN (0, 6) AS is_weekend, count(eid) AS n_reviews
        FROM days LEFT JOIN rev ON CAST(review_date AS DATE) = date
        GROUP BY date_id, date""",
    ),
    "fact_reviews": sql(
        STAR,
        FACTS,
    ),
    "fact_classifications": sql(STAR, "SELECT * FROM cls"),
    "fact_tickets": sql(STAR, "SELECT * FROM tck"),
    # marts
    "per_day_brand": sql(
        STAR + DAILY,
        f"""SELECT * REPLACE ({dec("avg_rating", 6)} AS avg_rating,
                              {dec("share_critical", 6)} AS share_critical) FROM daily""",
    ),
    "competitor_avg": sql(
        STAR + DAILY,
        f"""SELECT date_id, {dec("competitor_avg_rating", 6)} AS competitor_avg_rating
            FROM rivals""",
    ),
    "ticket_resolution": sql(
        STAR,
        f"""
        SELECT f.date_id, count(*) AS tickets_open,
               {dec("count(*) FILTER (st.is_terminal) / count(*)", 6)} AS resolution_rate
        FROM tck t JOIN fact f ON f.id = t.review_id
        JOIN statuses st ON st.id = CAST(f.source_review_id AS BIGINT) % 4 + 1
        GROUP BY f.date_id""",
    ),
    "dm_direction_synthese": sql(STAR + DAILY, SYNTHESIS),
    "marketing_agg": sql(STAR + CELLS, "SELECT * FROM cells"),
    "focus_baseline": sql(
        STAR + CELLS,
        f"SELECT category_id, {dec('focus_volume', 6)} AS focus_volume FROM focus",
    ),
    "dm_marketing_voc": sql(STAR + CELLS, VOICE),
    "dm_finance_litiges": sql(
        STAR,
        f"""
        SELECT id AS review_id, review_key, date_id, {label("brands", "brand_id")} AS brand_label,
               {label("sources", "source_id")} AS source_label, category_code,
               {label("categories", "cid")} AS category_label,
               {label("severities", "severity_id")} AS severity_label, rating, vendor_responded,
               response_latency_days, substr(text, 1, 280) AS review_excerpt, review_date
        FROM joined
        WHERE cid IN (SELECT id FROM categories
                      WHERE code IN ('transparence_financiere', 'parcours_paiement'))
          AND brand_id IS NOT NULL""",
    ),
    "dm_sav_tickets": sql(
        STAR,
        f"""
        SELECT tck.id AS ticket_id, review_id, tck.review_key, {label("categories", "cid")} AS category_label,
               {label("severities", "tck.severity_id")} AS severity_label,
               {label("statuses", "status_id")} AS status_label, assignee,
               CAST(date_sub('day', created_at, TIMESTAMP '2024-02-10 00:00:00') AS INTEGER)
                   AS days_open,
               substr(text, 1, 280) AS review_excerpt, vendor_responded,
               {label("brands", "brand_id")} AS brand_label,
               {label("sources", "source_id")} AS source_label, created_at
        FROM tck, urgent WHERE urgent.id = review_id AND brand_id IS NOT NULL""",
    ),
    "mart_counts": sql(
        STAR + CELLS,
        f"SELECT brand_label, count(*) AS n_rows FROM ({VOICE}) GROUP BY brand_label",
    ),
    # activation
    "weekly_high": sql(STAR + WEEKLY, "SELECT * FROM weekly"),
    "recent_weeks": sql(STAR + WEEKLY, "SELECT * FROM weeks"),
    "spike_alerts": sql(STAR + WEEKLY, "SELECT * FROM spikes"),
    "alert_records": sql(
        STAR + WEEKLY,
        f"""
        SELECT {numbered_text("ALERT-", "n")} AS alert_id,
               TIMESTAMP '2024-02-10 00:00:00' AS detected_at, brand, category, current_week,
               current_high, baseline_avg_high, ratio
        FROM (SELECT *, row_number() OVER (ORDER BY ratio DESC, brand, category) AS n
              FROM (SELECT *, current_high / baseline_avg_high AS ratio FROM spikes))""",
    ),
    "alerts_csv": sql(
        STAR + WEEKLY,
        f"""
        SELECT {numbered_text("ALERT-", "n")} AS alert_id,
               TIMESTAMP '2024-02-10 00:00:00' AS detected_at, brand, category, current_week,
               current_high, baseline_avg_high, ratio
        FROM (SELECT *, row_number() OVER (ORDER BY ratio DESC, brand, category) AS n
              FROM (SELECT *, current_high / baseline_avg_high AS ratio FROM spikes))""",
    ),
    "critical_reviews": sql(STAR + CRITICAL, "SELECT * FROM crit"),
    "ticket_numbers": sql(
        STAR,
        f"""
        SELECT review_key, {numbered_text("TICK-", "n")} AS ticket_id
        FROM (SELECT review_key, row_number() OVER (ORDER BY review_date DESC NULLS FIRST,
                                                    review_key) AS n FROM fact)""",
    ),
    "owner_routing": sql(
        STAR,
        f"""SELECT category_code, {OWNER} AS owner_team, count(*) AS n_reviews
            FROM fact GROUP BY ALL""",
    ),
    "tickets": sql(STAR + TICKETS, "SELECT * FROM tickets"),
    "tickets_csv": sql(
        STAR + TICKETS,
        """SELECT ticket_id, review_id, occurred_at, brand, source, category, severity, rating, status,
                  owner_team, excerpt FROM tickets""",
    ),
    "new_tickets": sql(
        STAR + TICKETS + KNOWN,
        """SELECT ticket_id, review_key, owner_team FROM tickets
           WHERE review_key NOT IN (SELECT review_key FROM known)""",
    ),
    "ledger_days": sql(
        STAR + TICKETS,
        """SELECT review_key, CASE WHEN review_id % 3 = 0 THEN 'd1' ELSE 'd2' END AS run_id
           FROM tickets WHERE review_id % 3 = 0 OR review_id % 2 = 0""",
    ),
    "ticket_payloads": sql(
        STAR + TICKETS,
        f"""SELECT ticket_id, review_key, CAST({PROPERTIES} AS VARCHAR) AS properties
            FROM tickets""",
    ),
    "ticket_stats": sql(
        STAR + TICKETS + KNOWN,
        """SELECT count(*) FILTER (k.review_key IS NULL) AS created,
                  count(*) FILTER (k.review_key IS NOT NULL) AS skipped
           FROM tickets t LEFT JOIN known k USING (review_key)""",
    ),
    "run_recap": sql(STAR + TICKETS + KNOWN + WEEKLY, RECAP),
    "daily_recap": sql(DAY, RECAP),
    "daily_facts": sql(
        DAY,
        """SELECT id, review_key, source_review_id, source_id, brand_id, date_id, review_date,
                  persona_id, rating, text, 'fr' AS language, author_handle, app_version,
                  vendor_responded, vendor_response_at, response_latency_days, is_exploitable,
                  exclusion_reason, collected_at FROM fact""",
    ),
    "daily_direction": sql(
        DAY + DAILY,
        f"""
        SELECT date_id, brand_label, total_reviews, {dec("avg_rating", 2)} AS avg_rating,
               {dec("share_critical", 3)} AS share_critical,
               coalesce(solved, 0.0) AS ticket_resolution_rate,
               CASE WHEN is_focus THEN {dec("avg_rating - competitor_avg_rating", 2)} END
                   AS gap_vs_competitors
        FROM daily LEFT JOIN rivals USING (date_id)
        LEFT JOIN (SELECT date_id, avg(CASE WHEN status_id IN
                              (SELECT id FROM statuses WHERE is_terminal) THEN 1 ELSE 0 END) AS solved
                   FROM tck JOIN fact ON fact.id = tck.review_id GROUP BY date_id) USING (date_id)""",
    ),
    # quality checks
    "dq_not_null": sql(
        FAULTY,
        "\nUNION ALL ".join(null_check("raw_reviews", "faulty", c) for c in RAW_NULLS),
    ),
    "dq_accepted_values": sql(
        FAULTY,
        "\nUNION ALL ".join(
            accepted_check("raw_reviews", "faulty", c, v) for c, v in RAW_ACCEPTED.items()
        ),
    ),
    "dq_unique": sql(RAW, unique_check("raw_reviews", "raw", "source_review_id")),
    "dq_report": sql(FAULTY + star_ctes("faulty") + DAYS, REPORT),
    "dq_gate": sql(FAULTY + star_ctes("faulty") + DAYS, f"SELECT * FROM ({REPORT}) WHERE failures > 0"),
    "nan_becomes_null": sql(
        RAW,
        f"""SELECT {KEY}, CASE WHEN {NUMBER} % 5 <> 0 THEN severity_text_score END AS severity_text_score,
                   severity_rating_score FROM raw""",
    ),
}
