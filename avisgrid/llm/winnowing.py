"""Winnowed document fingerprints in column expressions only.

Tokens are the runs of non-blank characters of the lower-cased text, longer runs in pieces
of ``PIECE``. Grams of GRAM tokens are hashed by doubling, every window of WINDOW
grams keeps its smallest hash, rightmost on ties, and the kept hashes carry their position:
any run of GRAM + WINDOW - 1 tokens that two texts share gives them a common hash.
A text with fewer tokens counts as one gram, one with fewer grams as one window.

Null counts as empty; an empty text has an empty fingerprint, two of which are alike (1.0).
Ids order rows, nulls first, then text; the last document is followed by the first, a lone
document by itself. Repeated rows stay. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from avisgrid.llm.common import n_code_points

GRAM, WINDOW, PIECE = 4, 8, 20  # grams and windows are built by doubling: powers of two
POS_BITS = 30  # a text has fewer than 2**30 tokens
HASH_BITS = 33
BUCKET_ROWS = 2048
MAX_BUCKETS = 65536


def _ahead(column: str, by: int) -> Column:
    return F.slice(column, F.lit(by + 1), F.greatest(F.size(column) - by, F.lit(0)))


def _whole(column: str, width: int) -> Column:
    """The elements that start a whole run of ``width``; the first one if there is none."""
    n = F.size(column)
    return F.slice(column, F.lit(1), F.greatest(n - (width - 1), F.least(n, F.lit(1))))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: kept hashes with positions, packed into longs (hash above position).

    Every step is a projection of its own, so that none is computed twice.
    """
    c = f"_{out}"
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0))
    df = df.withColumn(c, F.transform(tokens, lambda t: F.xxhash64(t)))
    step = 1
    while step < GRAM:
        df = df.withColumn(c, F.zip_with(c, _ahead(c, step), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    low, last = (1 << HASH_BITS) - 1, (1 << POS_BITS) - 1
    df = df.withColumn(
        c,
        F.transform(
            _whole(c, GRAM),
            lambda g, i: F.shiftleft(g.bitwiseAND(F.lit(low)), POS_BITS)
            + (F.lit(last).cast("long") - i),
        ),
    )
    step = 1
    while step < WINDOW:
        df = df.withColumn(c, F.zip_with(c, _ahead(c, step), lambda a, b: F.least(a, b)))
        step *= 2
    return df.withColumn(out, F.array_distinct(_whole(c, WINDOW))).drop(c)


def hashes(packed: str) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, POS_BITS)))


def printed(packed: str) -> Column:
    """``hash:position`` of every kept gram in text order, comma-joined."""
    last = F.lit((1 << POS_BITS) - 1).cast("long")
    return F.array_join(
        F.transform(
            packed,
            lambda x: F.concat(
                F.lower(F.hex(F.shiftright(x, POS_BITS))),
                F.lit(":"),
                (last - x.bitwiseAND(last)).cast("string"),
            ),
        ),
        ",",
    )


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two hash lists."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Index of the last bound not above the key, by bisection over a literal array."""
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = max(1, len(bounds).bit_length())

    def halve(state: Column, _: Column) -> Column:
        mid = ((state["lo"] + state["hi"] + 1) / 2).cast("int")
        above = F.element_at(array, mid + 1) > key
        return F.struct(
            F.when(above, state["lo"]).otherwise(mid).alias("lo"),
            F.when(above, F.greatest(mid - 1, state["lo"])).otherwise(state["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds) - 1).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["lo"])


def with_next(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Add columns of the following row in the order of ``key``, then text, around the end.

    Rows move once, into buckets between quantiles of the key; the rows that open a bucket
    also go to the end of the one before. Needs a column ``text``.
    """
    lowest = -(1 << 63)
    place = F.coalesce(F.col(key).cast("long"), F.lit(lowest))
    keys = df.select(place.alias("k"))
    n_rows, first = keys.agg(F.count(F.lit(1)), F.min("k")).first()
    if not n_rows:
        return df.withColumns({out: F.col(c) for out, c in columns.items()})
    n = max(1, min(MAX_BUCKETS, -(-n_rows // BUCKET_ROWS)))
    cuts = keys.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    # Quantiles come back as doubles: round down to a whole key, then to one that exists.
    cuts = sorted({int(c) for c in cuts} | {first})
    df = df.withColumns({"_k": place, "_b": _bucket(place, cuts)})
    opens = df.groupBy("_b").agg(F.min("_k").alias("_k")).orderBy("_b").collect()
    # One entry per bucket, MAX_BUCKETS at most.
    before = {row["_b"]: opens[i - 1]["_b"] for i, row in enumerate(opens)}
    first_key = F.array(*[F.lit(v).cast("long") for v in _dense(opens, len(cuts), "_k")])
    previous = F.array(*[F.lit(before.get(i, 0)) for i in range(len(cuts))])
    is_first = F.col("_k") == F.element_at(first_key, F.col("_b") + 1)
    both = F.array(
        F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy")),
        F.struct(F.element_at(previous, F.col("_b") + 1).alias("b"), F.lit(True).alias("copy")),
    )
    dealt = df.withColumn("_to", F.explode(F.when(is_first, both).otherwise(F.slice(both, 1, 1))))
    order = W.partitionBy("_to.b").orderBy(
        "_to.copy", "_k", F.col(key).asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    led = dealt.withColumns({out: F.lead(c).over(order) for out, c in columns.items()})
    return led.filter(~F.col("_to.copy")).drop("_k", "_b", "_to")


def _dense(rows: list, n: int, field: str) -> list[int]:
    found = {row["_b"]: row[field] for row in rows}
    return [found.get(i, 0) for i in range(n)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likenesses."""
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = with_fingerprint(texts, "text", "fp")
    paired = with_next(own, "doc_id", {"next_text": "text", "next_fp": "fp"})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.left(F.col("text"), n - half), F.left(F.col("next_text"), half)
    )
    paired = paired.select(
        "doc_id",
        n_code_points(F.col("text")).alias("n_chars"),
        "fp",
        hashes("next_fp").alias("next_h"),
        edited.alias("edited"),
    )
    both = with_fingerprint(paired, "edited", "efp")
    both = both.withColumns({"h": hashes("fp"), "eh": hashes("efp")})
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed("fp").alias("fingerprint"),
        printed("efp").alias("edited_fingerprint"),
        likeness("h", "eh").alias("near_edited"),
        likeness("h", "next_h").alias("near_next"),
    )
