"""Line deduplication in column expressions: sorted hash ranges give every document a keep bitmap.

A line's key is the line without blanks at both ends, A-Z in lower case; its 128-bit hash stands
for it. Occurrences (hash, document, position) are range-partitioned and sorted by all of
these, so a key that half of the documents hold fills several ranges instead of one task. Inside a range a
key's occurrences are a run: its first one and the number of its documents are read off while the
run passes. Only a key at the border of two ranges can go on in another one; those, two for each range at
most, are counted by an aggregate of their own.

What returns is one row per document that loses a line: ``edges``, its bitmap in compressed form, the places
where runs of dropped lines begin and end. Texts stay where they are until ``applied`` puts the bitmaps on them.

A document is an id and a text: repeated rows count once and get the same bitmap. Null text counts as
empty, which is one empty line; empty keys are always kept. Null ids come first. An empty table
gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from avisgrid.session import written

MIN_DOCS = 10
BLANKS = " \t\n\x0b\f\r"
KEY = ("h1", "h2")
DOC = ("doc_id", "t1", "t2")
_SECOND = 0x9E3779B9  # seeds the second half of a hash


def _folded(line: Column) -> Column:
    """A-Z in lower case; other letters stay, also those that ``lower`` knows."""
    plain = F.octet_length(line) == F.char_length(line)
    return F.when(plain, F.lower(line)).otherwise(
        F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    )


def _halves(value: Column) -> tuple[Column, Column]:
    return F.xxhash64(value), F.xxhash64(F.lit(_SECOND), value)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, text``: every row with the hash of its text."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    t1, t2 = _halves(F.col("text"))
    return rows.select("doc_id", t1.alias("t1"), t2.alias("t2"), "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line with a key, in ranges (``part``) sorted by key, document and position.

    Written once: a lost executor cannot move a range's border between two readings. ``tie``
    lets rows that are equal in everything else fill several ranges too.
    """
    lines = texts(docs).select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select(*DOC, "pos", F.trim(F.col("line"), F.lit(BLANKS)).alias("line")).filter("line <> ''")
    h1, h2 = _halves(_folded(F.col("line")))
    lines = lines.select(h1.alias("h1"), h2.alias("h2"), *DOC, "pos")
    order = (*KEY, *DOC, "pos", "tie")
    ranged = lines.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return written(ranged.drop("tie"), "lines")


def border_totals(lines: DataFrame) -> DataFrame:
    """Documents and first occurrence of every key that opens or closes a range."""
    key = F.struct(*KEY)
    ends = lines.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    # Two rows for each range at most, so the broadcast is bounded by the number of ranges.
    keys = ends.select(F.explode(F.array("lo", "hi")).alias("k")).select("k.*").distinct()
    held = lines.join(F.broadcast(keys), [*KEY], "left_semi")
    firsts = held.groupBy(*KEY, *DOC).agg(F.min("pos").alias("pos"))
    return firsts.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("all_docs"), F.min(F.struct(*DOC, "pos")).alias("first")
    )


def counted(lines: DataFrame) -> DataFrame:
    """Every occurrence with the number of its key's documents and whether it is the key's first."""
    run = W.partitionBy("part", *KEY).orderBy(*DOC, "pos")
    whole = W.partitionBy("part", *KEY)
    doc = F.struct(*DOC)
    row = F.row_number().over(run)
    opens = F.when((row == 1) | ~doc.eqNullSafe(F.lag(doc).over(run)), 1).otherwise(0)
    rows = lines.withColumns({"opens": opens, "place": row})
    rows = rows.withColumn("here", F.sum("opens").over(whole))
    # Bounded like the keys above.
    rows = rows.join(F.broadcast(border_totals(lines)), [*KEY], "left")
    is_first = F.when(F.col("all_docs").isNull(), F.col("place") == 1).otherwise(
        F.struct(*DOC, "pos").eqNullSafe(F.col("first"))
    )
    return rows.select(*DOC, "pos", F.coalesce("all_docs", "here").alias("n_docs"), is_first.alias("is_first"))


def _edges(dropped: str) -> Column:
    """Where runs of dropped positions begin and end, given the sorted positions."""
    at = F.col(dropped)
    last = F.size(at) - 1
    opens = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) < p - 1))
    closes = F.filter(at, lambda p, i: (i == last) | (F.get(at, i + 1) > p + 1))
    return F.flatten(F.zip_with(opens, closes, lambda a, b: F.array(a, b + 1)))


def bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``doc_id, t1, t2, edges`` of every document that loses a line.

    Keys in at least ``min_docs`` documents lose all their lines, or with ``keep_first`` all but the
    first in the order of ids. With ``min_docs=1, keep_first=True`` every line of the corpus stays once.
    """
    gone = counted(occurrences(docs)).filter(F.col("n_docs") >= min_docs)
    if keep_first:
        gone = gone.filter(~F.col("is_first"))
    # Positions of one document, as many as it has lines; a set, so that repeated rows merge early.
    listed = gone.groupBy(*DOC).agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return listed.select(*DOC, _edges("at").alias("edges"))


def applied(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped, kept, edges`` of every row under its bitmap."""
    marks = marks.select(F.col("doc_id").alias("d"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "edges")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2"))
    rows = texts(docs).join(marks.hint("merge"), same, "left").select("doc_id", "text", "edges")
    rows = rows.withColumn("lines", F.split("text", "\n", -1))
    n, edges = F.size("lines"), F.col("edges")

    def kept_run(k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get(edges, 2 * k - 1))
        return F.slice("lines", begin + 1, F.coalesce(F.get(edges, 2 * k), n) - begin)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), (F.size(edges) / 2).cast("int")), kept_run))
    lengths = F.transform(edges, lambda e, i: F.when(i % 2 == 0, -e).otherwise(e).cast("long"))
    dropped = F.aggregate(lengths, F.lit(0).cast("long"), lambda total, e: total + e)
    return rows.select(
        "doc_id",
        "text",
        n.cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0).cast("long")).alias("n_dropped"),
        F.when(edges.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"),
        "edges",
    )


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """Every row's text without the lines that its bitmap drops."""
    return applied(docs, bitmaps(docs, min_docs, keep_first))


def digests(docs: DataFrame) -> DataFrame:
    """Line counts and the checksum of the kept text."""
    return deduplicated(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
