"""Second-pass classifier: candidates, prompts, scoring, strict reply parsing, merge."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avisgrid.functions import taxonomy as tx
from avisgrid.functions import text as tt
from avisgrid.functions.strict_json import STRICT, strict_value

KEY = ["source_code", "source_review_id"]

# A scorer takes a batch of prompts and returns one reply (or None) per prompt.
Scorer = Callable[[pd.Series], pd.Series]

@dataclass(frozen=True)
class Limits:
    """How a worker asks: the time of one call, prompts in a call, and calls at once when prompts go one by one."""

    seconds: float = 60.0
    batch: int = 64
    at_once: int = 8


LIMITS = Limits()

REPLY_SCHEMA = "source_review_id string, source_code string, reply string"


def is_candidate() -> Column:
    return F.col("is_exploitable") & (F.col("category_code") == tx.UNCLASSIFIED)


def candidates(raw: DataFrame) -> DataFrame:
    """Usable reviews the keywords could not classify."""
    return raw.where(is_candidate()).select("source_review_id", "source_code", "text")


def prompt(text: Column) -> Column:
    """Instruction, category list and the trimmed review; its triple quotes become one."""
    listed = "\n".join(f"- {code}: {meaning}" for code, meaning in tx.MODEL_CATEGORIES.items())
    head = tx.PROMPT_HEAD + listed + tx.PROMPT_BEFORE_TEXT
    body = F.replace(tt.strip(text), F.lit('"""'), F.lit('"'))
    return F.when(
        ~tt.is_blank(text), F.concat(F.lit(head), body, F.lit(tx.PROMPT_AFTER_TEXT))
    )


def prompts(chosen: DataFrame) -> DataFrame:
    return chosen.select("source_review_id", "source_code", prompt(F.col("text")).alias("prompt"))


def replies(prompted: DataFrame, scorer: Scorer, limits: Limits = LIMITS) -> DataFrame:
    """Ask the scorer, some prompts at a time.

    A call that fails or does not end in time is repeated prompt by prompt, so an error or a
    prompt that hangs costs one verdict only.  Rows without a prompt are not sent.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["source_review_id", "source_code"]].assign(reply=_answers(batch["prompt"], scorer, limits))

    return prompted.mapInPandas(ask, REPLY_SCHEMA)


def _answers(prompts: pd.Series, scorer: Scorer, limits: Limits) -> pd.Series:
    """One reply for each row, None where there is no prompt or no answer."""
    answer = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
    sent = prompts[prompts.notna()]
    found = []
    for at in range(0, len(sent), limits.batch):
        found += _ask(sent.iloc[at : at + limits.batch], scorer, limits)
    answer[sent.index] = pd.Series(found, index=sent.index, dtype=object)
    return answer


class _Call(threading.Thread):
    """A call that nobody has to wait for: one that hangs is left behind and dies with its worker."""

    def __init__(self, scorer: Scorer, batch: pd.Series, seconds: float) -> None:
        super().__init__(daemon=True)
        self.scorer, self.batch, self.answers = scorer, batch, None
        self.ends = time.monotonic() + seconds
        self.start()

    def run(self) -> None:
        try:
            answers = list(self.scorer(self.batch))
            if len(answers) == len(self.batch):
                self.answers = answers
        except Exception:  # noqa: BLE001, S110 - a scorer may raise anything
            pass

    def result(self) -> list | None:
        """The answers, if they come in time and are as many as the prompts."""
        self.join(max(0.0, self.ends - time.monotonic()))
        return None if self.is_alive() else self.answers


def _ask(batch: pd.Series, scorer: Scorer, limits: Limits) -> list:
    """One reply for each prompt of a call; after a failure each prompt has a call of its own."""
    answers = _Call(scorer, batch, limits.seconds).result()
    if answers is not None:
        return answers
    if len(batch) == 1:
        return [None]
    found: list = []
    for at in range(0, len(batch), limits.at_once):
        calls = [_Call(scorer, batch.iloc[[i]], limits.seconds) for i in range(at, min(at + limits.at_once, len(batch)))]
        found += [(c.result() or [None])[0] for c in calls]
    return found


def _confidence(reply: Column) -> Column:
    """Number or numeric text within [0, 1]; everything else counts as the default."""
    text = F.from_json(reply, "confidence string", STRICT)["confidence"]
    # A JSON true counts as 1, the text "true" does not count.
    flag = F.from_json(reply, "confidence boolean", STRICT)["confidence"]
    # A bare NaN or Infinity is read as a text with quotes.
    bare = F.regexp_replace(text, r'^"(NaN|-?Infinity)"$', "$1")
    number = F.when(flag.isNull(), F.btrim(bare).try_cast("double"))
    value = F.coalesce(F.when(flag, 1.0).when(~flag, 0.0), number, F.lit(tx.DEFAULT_CONFIDENCE))
    return F.when(F.isnan(value), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def parse_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``verdict_category`` and ``verdict_confidence``; both NULL without a verdict.

    The whole reply must be one JSON value; if it is none, the part from the first ``{``
    to the last ``}`` must be.  The category must be one of the known codes.
    """
    # A reply that is one JSON value of another kind is read, and gives no verdict.
    is_object = F.col(reply).rlike(r"^[ \t\n\r]*\{")
    whole = F.when(strict_value(F.col(reply)).isNotNull(), F.when(is_object, F.col(reply)).otherwise(""))
    fragment = strict_value(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")))
    parsed = df.withColumn("_json", F.coalesce(whole, fragment))
    read = F.from_json(F.col("_json"), "category string", STRICT)["category"]
    category = F.when(read.isin(*tx.MODEL_CATEGORIES), read)
    return (
        parsed.withColumn("verdict_category", category)
        .withColumn(
            "verdict_confidence",
            F.when(F.col("verdict_category").isNotNull(), _confidence(F.col("_json"))),
        )
        .drop("_json")
    )


def overrides(verdicts: DataFrame) -> DataFrame:
    """One verdict that changes something per review: the most confident, then by code."""
    best = F.struct(
        F.col("verdict_confidence"), F.col("verdict_category").alias("verdict_category")
    )
    return (
        verdicts.where(F.col("verdict_category") != tx.UNCLASSIFIED)
        .groupBy(*KEY)
        .agg(F.max(best)["verdict_category"].alias("_verdict"))
    )


def apply_verdicts(raw: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Replace the category where a verdict exists; severity keeps its first value.

    Only candidates can have a verdict, so only they meet the verdicts; the other rows stay
    where they are.
    """
    found = F.col("_verdict").isNotNull()
    asked = F.coalesce(is_candidate(), F.lit(False))
    merged = (
        raw.where(asked)
        .join(overrides(verdicts), KEY, "left")
        .withColumns(
            {
                "category_code": F.coalesce("_verdict", "category_code"),
                "category_source": F.when(found, tx.SOURCE_MODEL).otherwise(
                    F.col("category_source")
                ),
            }
        )
        .select(*raw.columns)
    )
    return raw.where(~asked).unionByName(merged)


def verdict_stats(raw: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Candidates, updated and skipped of a run; all zero when the model is off."""
    if verdicts is None:
        return raw.where(F.lit(False)).agg(
            *[F.count("*").alias(c) for c in ("candidates", "updated", "skipped")]
        )
    hit = F.col("_verdict").isNotNull()
    return (
        candidates(raw)
        .select(*KEY)
        .join(overrides(verdicts), KEY, "left")
        .agg(
            F.count("*").alias("candidates"),
            F.count_if(hit).alias("updated"),
            F.count_if(~hit).alias("skipped"),
        )
    )


def stored_stats(refined: DataFrame) -> DataFrame:
    """The same counts of a run that went through ``reclassify``, from what it wrote."""
    changed = F.col("category_source") == tx.SOURCE_MODEL
    left = F.coalesce(is_candidate(), F.lit(False)) & ~F.coalesce(changed, F.lit(False))
    return refined.agg(
        F.count_if(changed | left).alias("candidates"), F.count_if(changed).alias("updated"), F.count_if(left).alias("skipped")
    )


def classify_candidates(raw: DataFrame, scorer: Scorer, limits: Limits = LIMITS) -> DataFrame:
    """Candidates to verdicts: key, category and confidence."""
    answered = parse_replies(replies(prompts(candidates(raw)), scorer, limits))
    return answered.where(F.col("verdict_category").isNotNull()).select(
        *KEY, "verdict_category", "verdict_confidence"
    )


def reclassify(raw: DataFrame, scorer: Scorer, limits: Limits = LIMITS) -> DataFrame:
    """Second pass in place: score the candidates of a run and replace their category.

    Only the prompts travel to Python, the other columns and rows stay in the JVM, and no
    join or shuffle is needed.  Use it when the rows are being written anyway (a run holds
    each key once); ``apply_verdicts`` merges verdicts stored earlier.
    """

    def ask(batch: pd.Series) -> pd.Series:
        return _answers(batch, scorer, limits)

    asked = F.pandas_udf(ask, "string")(F.when(is_candidate(), prompt(F.col("text"))))
    scored = parse_replies(raw.withColumn("_reply", asked), "_reply")
    replaced = F.col("verdict_category") != tx.UNCLASSIFIED
    return scored.withColumns(
        {
            "category_code": F.when(replaced, F.col("verdict_category")).otherwise(
                F.col("category_code")
            ),
            "category_source": F.when(replaced, tx.SOURCE_MODEL).otherwise(
                F.col("category_source")
            ),
        }
    ).select(*raw.columns)
