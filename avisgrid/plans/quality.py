"""Declared checks on the tables: one aggregate per table, one report, one gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Allowed codes.
SOURCE_CODES = ("trustpilot", "google_play", "app_store")
BRAND_CODES = ("abritel", "airbnb", "booking")
SEVERITY_CODES = ("low", "medium", "high")
CATEGORY_SOURCES = ("heuristic", "llm")

NOT_NULL = {
    "raw_reviews": (
        "source_review_id", "source_code", "brand_code", "review_date", "is_exploitable",
    ),
    "fact_reviews": ("id", "source_id", "brand_id", "date_id", "is_exploitable"),
    "fact_classifications": ("id", "review_id", "category_id", "severity_id"),
    "fact_tickets": ("id", "review_id"),
    "dim_brand": ("id", "code"),
    "dim_source": ("id", "code"),
    "dim_category": ("id", "code"),
    "dim_severity": ("id", "code"),
    "dim_persona": ("id", "code"),
    "dim_date": ("date_id",),
}

UNIQUE = {
    "fact_reviews": ("id",),
    "fact_classifications": ("id",),
    "fact_tickets": ("id",),
    "dim_brand": ("id", "code"),
    "dim_source": ("id", "code"),
    "dim_category": ("id", "code"),
    "dim_severity": ("id", "code"),
    "dim_persona": ("id", "code"),
    "dim_date": ("date_id",),
}

ACCEPTED = {
    "raw_reviews": {
        "source_code": SOURCE_CODES,
        "brand_code": BRAND_CODES,
        "severity_code": SEVERITY_CODES,
        "category_source": CATEGORY_SOURCES,
    },
    "dim_severity": {"code": SEVERITY_CODES},
}

REPORT = ("table_name", "check_name", "column_name", "failures")


class QualityGateError(RuntimeError):
    """At least one check failed; activation must not run."""


def _row_rules(table: str) -> list[tuple[str, str, Column]]:
    """Check, column and the condition a bad row meets."""
    rules = [("not_null", c, F.col(c).isNull()) for c in NOT_NULL.get(table, ())]
    # NULL passes an accepted-values check: the comparison is NULL and not counted.
    rules += [
        ("accepted_values", c, ~F.col(c).isin(*allowed))
        for c, allowed in ACCEPTED.get(table, {}).items()
    ]
    return rules


def row_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """NULL and accepted-value violations of all tables in one aggregate.

    Every table contributes one flag per rule; the flags are summed per table, so a row
    is read once whatever the number of rules, and one line per table is shuffled.
    """
    rules = {t: _row_rules(t) for t in tables if _row_rules(t)}
    width = max(len(r) for r in rules.values())
    flags = [f"flag{i}" for i in range(width)]

    def padded(conditions: list[Column]) -> list[Column]:
        conditions = conditions + [F.lit(False)] * (width - len(conditions))
        return [c.alias(name) for c, name in zip(conditions, flags)]

    flagged = [
        tables[t].select(F.lit(t).alias("table_name"), *padded([bad for *_, bad in r]))
        for t, r in rules.items()
    ]
    spark = flagged[0].sparkSession
    # A line without a flag keeps tables without rows in the report.
    lines = [F.struct(F.lit(t).alias("table_name"), *padded([])) for t in rules]
    flagged.append(spark.range(1).select(F.inline(F.array(*lines))))
    sums = (
        reduce(DataFrame.unionByName, flagged)
        .groupBy("table_name")
        .agg(*[F.count_if(name).alias(name) for name in flags])
    )
    report_lines = F.when(F.lit(False), F.lit(None))
    for t, r in rules.items():
        found = F.array(
            *[
                F.struct(
                    F.lit(check).alias("check_name"),
                    F.lit(column).alias("column_name"),
                    F.col(name).alias("failures"),
                )
                for (check, column, _), name in zip(r, flags)
            ]
        )
        report_lines = report_lines.when(F.col("table_name") == t, found)
    return sums.select("table_name", F.inline(report_lines))


def unique_checks(tables: dict[str, DataFrame], declared: dict[str, tuple]) -> DataFrame:
    """Values that occur more than once per declared column; NULL is ignored.

    All columns share one shuffle; whole numbers stay numbers, other types compare as text.
    """
    values, zeros = [], []
    for table, columns in declared.items():
        df = tables[table]
        for column in columns:
            numeric = isinstance(df.schema[column].dataType, T.IntegralType)
            name = [F.lit(table).alias("table_name"), F.lit(column).alias("column_name")]
            value = F.col(column)
            values.append(
                df.where(value.isNotNull()).select(
                    *name,
                    (value.cast("bigint") if numeric else F.lit(None).cast("bigint")).alias("num"),
                    (F.lit(None).cast("string") if numeric else value.cast("string")).alias("txt"),
                )
            )
            zeros.append(F.struct(*name, F.lit(0).cast("bigint").alias("failures")))
    counted = reduce(DataFrame.unionByName, values).groupBy(
        "table_name", "column_name", "num", "txt"
    ).agg(F.count("*").alias("n"))
    repeated = counted.groupBy("table_name", "column_name").agg(
        F.count_if(F.col("n") > 1).alias("failures")
    )
    # A table without rows still has its line in the report.
    lines = counted.sparkSession.range(1).select(F.inline(F.array(*zeros)))
    return (
        repeated.unionByName(lines)
        .groupBy("table_name", "column_name")
        .agg(F.sum("failures").alias("failures"))
        .select("table_name", F.lit("unique").alias("check_name"), "column_name", "failures")
    )


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """All declared checks of the given tables, one row each."""
    parts = [row_checks(tables)]
    unique = {t: c for t, c in UNIQUE.items() if t in tables}
    if unique:
        parts.append(unique_checks(tables, unique))
    return reduce(DataFrame.unionByName, parts).select(*REPORT)


def failed_checks(checked: DataFrame) -> DataFrame:
    """What the gate stops at."""
    return checked.where(F.col("failures") > 0)


def gate(checked: DataFrame) -> None:
    """Stop when a check failed; the report has one row per check."""
    failed = failed_checks(checked).collect()
    if failed:
        listed = ", ".join(f"{r.table_name}.{r.column_name} {r.check_name}" for r in failed)
        raise QualityGateError(f"failed checks: {listed}")
