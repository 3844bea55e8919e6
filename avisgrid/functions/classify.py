"""Keyword classification of review text: category, severity, persona."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avisgrid.functions import taxonomy as tx
from avisgrid.functions import text as tt


def bound(text: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``text`` (or what was found in it) once per row and hand the value to ``fn``.

    The optimizer may inline the value into every use; as a one-element array it is computed once.
    """
    return F.element_at(F.transform(F.array(text), fn), 1)


def keyword_list(keywords: Iterable[str]) -> Column:
    """Literal array, folded to a constant by the optimizer."""
    return F.expr(f"array({', '.join(tt.quoted(k) for k in keywords)})")


def n_of(found: Column, keywords: Iterable[str]) -> Column:
    """How many of the keywords are among those found in a text, 0 for a NULL text."""
    return F.coalesce(F.size(F.array_intersect(found, keyword_list(keywords))), F.lit(0))


def any_of(found: Column, keywords: Iterable[str]) -> Column:
    return F.arrays_overlap(found, keyword_list(keywords))


CATEGORY_WORDS = tuple(k for words in tx.CATEGORY_KEYWORDS.values() for k in words)
# The words that end a negation: the last group of its pattern.
NEGATED_WORDS = tuple(tx.NEGATION_PATTERN.rsplit("(?:", 1)[1].rstrip(")").split("|"))
ALL_WORDS = (*CATEGORY_WORDS, *tx.SEVERITY_KEYWORDS, *tx.OWNER_PATTERNS, *NEGATED_WORDS)


def score_column(category: str) -> str:
    return f"n_{category}"


def category_scores(searched: Column) -> Column:
    """Struct with one keyword count per category."""
    return bound(
        tt.keywords_in(searched, CATEGORY_WORDS),
        lambda found: F.struct(
            *[n_of(found, words).alias(score_column(c)) for c, words in tx.CATEGORY_KEYWORDS.items()]
        ),
    )


def best_category(counts: dict[str, Column]) -> Column:
    """Highest count wins, ties go to the first in list order, zero is unclassified."""
    top = F.greatest(*counts.values())
    choice = F.when(F.coalesce(top, F.lit(0)) == 0, tx.UNCLASSIFIED)
    for code, n in counts.items():
        choice = choice.when(n == top, code)
    return choice


def rating_score(rating: Column) -> Column:
    """(5 - rating) / 4 within [0, 1]; a missing or zero rating scores 0."""
    r = F.coalesce(rating.cast("int"), F.lit(0))
    return F.when(r == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(5) - r) / F.lit(4.0)))
    )


def text_score(n_keywords: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(n_keywords, F.lit(0)) / F.lit(2.0))


def severity(score: Column, rating: Column, category: Column) -> Column:
    r = F.coalesce(rating.cast("int"), F.lit(0))
    return (
        F.when(score >= 0.5, "high")
        .when(r == 1, "high")
        .when((r == 2) & category.isin(*tx.ESCALATED_CATEGORIES), "high")
        .when(r == 2, "medium")
        .otherwise("low")
    )


def persona(text: Column, owner: Column) -> Column:
    """``owner`` says whether the folded text has an owner's words."""
    return (
        F.when(tt.is_blank(text), "indetermine")
        .when(owner, "proprietaire")
        .otherwise("locataire")
    )


def with_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``is_exploitable`` and ``exclusion_reason``."""
    return (
        df.withColumn("_norm", tt.normalize(F.col(text)))
        .withColumn("exclusion_reason", tt.exclusion_reason(F.col(text), F.col("_norm")))
        .withColumn("is_exploitable", F.col("exclusion_reason").isNull())
        .drop("_norm")
    )


def with_text_classes(df: DataFrame, text: str = "text", rating: str = "rating") -> DataFrame:
    """Quality, category, severity and persona in one narrow chain of projections.

    The folded text is a projection of its own, computed once per row, and searched once for all
    words; only where it has a word that a negation may take away it is searched again without negations.
    """
    raw = F.col(text)
    staged = df.withColumn("_norm", tt.normalize(raw))
    # What was found comes out of lambdas, so the optimizer cannot search again for every list. Without
    # one of the words that a negation takes away nothing can be taken away.
    searches = bound(
        tt.keywords_in(F.col("_norm"), ALL_WORDS),
        lambda found: bound(
            F.when(
                any_of(found, NEGATED_WORDS), tt.keywords_in(tt.strip_negation(F.col("_norm")), CATEGORY_WORDS)
            ).otherwise(found),
            lambda left: F.struct(
                *[n_of(left, words).alias(score_column(c)) for c, words in tx.CATEGORY_KEYWORDS.items()],
                n_of(found, tx.SEVERITY_KEYWORDS).alias("n_severity"),
                F.coalesce(any_of(found, tx.OWNER_PATTERNS), F.lit(False)).alias("owner"),
            ),
        ),
    )
    staged = staged.withColumn("_scores", searches)
    scored = staged.withColumns(
        {
            "exclusion_reason": tt.exclusion_reason(raw, F.col("_norm")),
            "persona_code": persona(raw, F.col("_scores.owner")),
            "severity_text_score": text_score(F.col("_scores.n_severity")),
            "severity_rating_score": rating_score(F.col(rating)),
        }
    )
    counts = {code: F.col("_scores")[score_column(code)] for code in tx.CATEGORY_KEYWORDS}
    return (
        scored.withColumn("is_exploitable", F.col("exclusion_reason").isNull())
        .withColumn("category_code", best_category(counts))
        .withColumn(
            "severity_code",
            severity(F.col("severity_text_score"), F.col(rating), F.col("category_code")),
        )
        .drop("_norm", "_scores")
    )


def refine(df: DataFrame, classified_at: Column) -> DataFrame:
    """The whole refinement step over landed reviews: narrow, no shuffle."""
    return with_text_classes(df).withColumns(
        {"category_source": F.lit(tx.SOURCE_KEYWORDS), "classified_at": classified_at}
    )
