"""Text rules against plain Python on given and random texts."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from avisgrid.functions import classify as cl
from avisgrid.functions import taxonomy as tx
from avisgrid.functions import text as tt

QUALITY_CASES = [
    (None, "vide"),
    ("", "vide"),
    ("   ", "vide"),
    (" \t\x1c\x85  　\n", "vide"),
    ("(sans commentaire)", "placeholder"),
    ("N/A", "placeholder"),
    ("  ...  ", "placeholder"),
    ("…", "trop_court"),
    ("ko", "trop_court"),
    ("oui", "trop_court"),
    ("super", "trop_court"),
    ("👍👍👍👍👍👍 !!!", "non_textuel"),
    ("1234 5678 _", "non_textuel"),
    ("rien à dire", "generique_non_actionnable"),
    ("RIEN A DIRE", "generique_non_actionnable"),
    ("n'ai", "trop_court"),
    ("je n'ai", None),
    ("Le calendrier se fige chaque fois que je choisis deux nuits.", None),
    ("Je suis propriétaire et mon annonce ne se publie plus depuis hier.", None),
]

CATEGORY_CASES = [
    ("Deux débits pour un seul séjour : prélevé deux fois, toujours aucun remboursement", "transparence_financiere"),
    ("Le logement est devenu indisponible, réservation annulée à la dernière minute", "fiabilite_reservations"),
    ("Les tarifs sortent en dollars alors que je navigue depuis Lyon", "app_fr"),
    ("Trois appels à un SAV injoignable, deux courriels, aucune réponse", "service_client"),
    ("ras", "non_classe"),
    ("Je craignais le pire mais ce n'est pas une arnaque, je suis ravi du séjour", "non_classe"),
    ("This is not a scam", "non_classe"),
    ("prix en $", "app_fr"),
    ("paiement refusé", "transparence_financiere"),
    ("  ", "non_classe"),
    (None, "non_classe"),
]

SEVERITY_CASES = [
    ("Une arnaque, et un accueil honteux", 5, "high", 0.0, 1.0),
    ("rien à signaler", 1, "high", 1.0, 0.0),
    ("paiement bloqué", 2, "high", 0.75, 0.0),
    ("SAV lent", 2, "medium", 0.75, 0.0),
    ("super appli", 5, "low", 0.0, 0.0),
    ("super appli", None, "low", 0.0, 0.0),
    ("super appli", 0, "low", 0.0, 0.0),
    ("super appli", 9, "low", 0.0, 0.0),
    ("pas une arnaque", 5, "high", 0.0, 0.5),
]

PERSONA_CASES = [
    ("Propriétaire de deux gîtes, je suis mes annonces chaque soir", "proprietaire"),
    ("En tant qu'hôte je perds patience", "proprietaire"),
    ("La chambre louée n'avait pas de volets", "locataire"),
    (" ", "indetermine"),
    (None, "indetermine"),
]


def classes(spark, rows):
    df = spark.createDataFrame(
        [(i, t, r) for i, (t, r) in enumerate(rows)], "i int, text string, rating int"
    )
    return [r for r in cl.with_text_classes(df).orderBy("i").collect()]


def test_quality(spark):
    got = classes(spark, [(t, 3) for t, _ in QUALITY_CASES])
    assert [(r.text, r.exclusion_reason) for r in got] == QUALITY_CASES
    assert all(r.is_exploitable == (r.exclusion_reason is None) for r in got)


def test_category(spark):
    got = classes(spark, [(t, 3) for t, _ in CATEGORY_CASES])
    assert [(r.text, r.category_code) for r in got] == CATEGORY_CASES


def test_severity(spark):
    got = classes(spark, [(t, r) for t, r, *_ in SEVERITY_CASES])
    assert [
        (r.text, r.rating, r.severity_code, r.severity_rating_score, r.severity_text_score)
        for r in got
    ] == SEVERITY_CASES


def test_persona(spark):
    got = classes(spark, [(t, 3) for t, _ in PERSONA_CASES])
    assert [(r.text, r.persona_code) for r in got] == PERSONA_CASES


# --- brute force ------------------------------------------------------------


def fold(text):
    chars = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in chars if unicodedata.category(c) != "Mn")


def brute_quality(text):
    raw = (text or "").strip()
    if not raw:
        return "vide"
    if raw.lower() in tx.PLACEHOLDER_TEXTS:
        return "placeholder"
    if len(raw) < 5:
        return "trop_court"
    if sum(c.isalnum() and not c.isdecimal() for c in raw) < 3:
        return "non_textuel"
    folded = fold(raw)
    if len(re.findall(r"\w+", folded)) < 2:
        return "trop_court"
    return "generique_non_actionnable" if folded.strip() in tx.GENERIC_PHRASES else None


def brute_category(text):
    if not (text or "").strip():
        return "non_classe"
    searched = re.sub(tx.NEGATION_PATTERN, "", fold(text))
    best, top = "non_classe", 0
    for code, words in tx.CATEGORY_KEYWORDS.items():
        n = len([w for w in words if w in searched])
        if n > top:
            best, top = code, n
    return best


def random_texts(n):
    rng = random.Random(7)
    keywords = [k for words in tx.CATEGORY_KEYWORDS.values() for k in words]
    pieces = [
        *keywords, *tx.SEVERITY_KEYWORDS, *tx.OWNER_PATTERNS, *tx.GENERIC_PHRASES, "pas ", "plus",
        "ni une", "aucune ", "du tout ", "jamais de ", " ", " ", "\t", "é", "É", "Ç", "ß",
        "İ", "Ⅷ", "²", "½", "١", "한", "日本", "👍", "!", "_", "7", "'", "’", "…", "​", "ǆ",
        "ﬁ", "Å", "œ", "ÉTÉ", "no scam", "\x1f", "\x85",
    ]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 7))) for _ in range(n)]


def test_random_texts(spark):
    texts = random_texts(4000)
    got = classes(spark, [(t, 3) for t in texts])
    for row in got:
        folded = fold(row.text)
        assert row.exclusion_reason == brute_quality(row.text), repr(row.text)
        assert row.category_code == brute_category(row.text), repr(row.text)
        n = len([w for w in tx.SEVERITY_KEYWORDS if w in folded])
        assert row.severity_text_score == min(1.0, n / 2), repr(row.text)


def test_folding_equals_unicode_decomposition(spark):
    """Every lower-case character that folds to one base character."""
    chars = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    chars = [c for c in chars if len(fold(c)) <= 1 and unicodedata.category(c) != "Cn"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    wrong = [
        r.c for r in df.select("c", tt.normalize(F.col("c")).alias("n")).collect() if r.n != fold(r.c)
    ]
    assert wrong == []


@pytest.mark.parametrize(
    ("title", "body", "expected"),
    [
        ("Titre", "Corps", "Titre. Corps"),
        ("Titre.", "", "Titre"),
        ("", "Corps. ", "Corps."),
        ("...", "", "(sans commentaire)"),
        (None, None, "(sans commentaire)"),
        ("  ", "...", "..."),
        ("Non.", "Fini...", "Non.. Fini"),
    ],
)
def test_join_title_body(spark, title, body, expected):
    df = spark.createDataFrame([(title, body)], "t string, b string")
    assert df.select(tt.join_title_body(F.col("t"), F.col("b"))).first()[0] == expected


def test_keywords_are_found_in_one_pass(spark):
    """Overlapping, nested and cut keywords, against a test of each one."""


    rng, words = random.Random(1), sorted(set(cl.ALL_WORDS))
    rows = [(None,), ("",), ("$$",), ("annuleeannulation",)]
    for _ in range(400):
        parts = [(w := rng.choice(words))[: rng.randrange(1, len(w) + 1)] + rng.choice(["", "", " ", "s"]) for _ in range(rng.randrange(12))]
        rows.append(("".join(parts),))
    df = spark.createDataFrame(rows, "t string")
    for r in df.select("t", tt.keywords_in(F.col("t"), words).alias("found")).collect():
        expected = None if r.t is None else {w for w in words if w in r.t}
        assert (None if r.found is None else set(r.found)) == expected, r.t


def test_negations_change_the_categories_only(spark):

    rows = [("ce n'est pas une arnaque", 3), ("une arnaque", 3), ("pas complique du tout", 3), (None, 1), ("plus jamais de bug, honteux", 2)]
    df = spark.createDataFrame(rows, "text string, rating int")
    searched = tt.strip_negation(tt.normalize(F.col("text")))
    both = cl.with_text_classes(df.withColumn("s", cl.category_scores(searched))).withColumns(
        {"expected": cl.best_category({c: F.col("s")[cl.score_column(c)] for c in cl.tx.CATEGORY_KEYWORDS})}
    )
    for r in both.collect():
        assert r.category_code == r.expected, r.text
