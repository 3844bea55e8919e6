"""Second-pass model: strict reply parsing, scoring, merge, statistics."""

import json
import math
import time

import pandas as pd
from pyspark.sql import functions as F

from avisgrid.functions import taxonomy as tx
from avisgrid.operators import verdicts

REPLIES = [
    '{"confidence": 0.72, "category": "communication_hote"}',
    'Je dirais {"category": "qualite_annonces", "confidence": 0.55}, sans certitude.',
    '{"category": "meteo", "confidence": 0.8}',
    "je ne sais pas",
    '{"category" "app_fr"}',
    '{"category": "app_fr", "confidence": 3}',
    '{"category": "app_fr", "confidence": -0.5}',
    '{"category": "app_fr", "note": 1}',
    '{"category": "app_fr"} {"category": "service_client"}',
    '{"category": "app_fr"},{"category": "service_client"}',
    '{"category": "app_fr"}],[{"category": "service_client"}',
    '[{"category": "app_fr"}]',
    '"{\\"category\\": \\"app_fr\\"}"',
    "{'category': 'app_fr'}",
    '{"category": "app_fr",}',
    '{"category": ["app_fr"]}',
    '{"category": null}',
    '{"category": {"a": 1}}',
    '{"category": "app_fr", "confidence": null}',
    '{"category": "app_fr", "confidence": "0.25"}',
    '{"category": "app_fr", "confidence": " 0.25 "}',
    '{"category": "app_fr", "confidence": "haute"}',
    '{"category": "app_fr", "confidence": true}',
    '{"category": "app_fr", "confidence": false}',
    '{"category": "app_fr", "confidence": "true"}',
    '{"category": "app_fr", "confidence": [1]}',
    '{"category": "app_fr", "confidence": 1e-1}',
    '{"category": "app_fr", "confidence": "nan"}',
    '{"category": "app_fr", "confidence": NaN}',
    '{"category": "non_classe", "confidence": 0.3}',
    '{"other": {"category": "app_fr"}}',
    'x {"a": {"category": "app_fr"}} y',
    'début {"category":\n "app_fr"\n} fin }',
    '} {"category": "app_fr"}',
    '  {"category": "app_fr", "confidence": 0.4}\n',
    '{"category": "service_client", "category": "app_fr"}',
    "7",
    "null",
    "",
    " ",
    None,
]


def expected(reply):
    """The rule in plain Python: whole reply as JSON, else first { to last }."""
    if reply is None:
        return None
    data = None
    for part in (reply, reply[reply.find("{") : reply.rfind("}") + 1]):
        try:
            data = json.loads(part)
            break
        except json.JSONDecodeError:
            continue
    if not isinstance(data, dict):
        return None
    category = data.get("category")
    if not isinstance(category, str) or category not in tx.MODEL_CATEGORIES:
        return None
    try:
        value = float(data.get("confidence", 0.5))
    except (TypeError, ValueError):
        value = 0.5
    return category, 1.0 if math.isnan(value) else max(0.0, min(1.0, value))


def test_replies_read_like_strict_json(spark):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "i int, reply string")
    for row in verdicts.parse_replies(df).collect():
        want = expected(REPLIES[row.i])
        got = (row.verdict_category, row.verdict_confidence)
        assert got == (want or (None, None)), repr(row.reply)


def raw(spark, rows):
    return spark.createDataFrame(
        rows,
        "source_code string, source_review_id string, text string, is_exploitable boolean, "
        "category_code string, category_source string",
    )


ROWS = [
    ("trustpilot", "r1", "Texte que les mots-clés ne classent pas", True, "non_classe", "heuristic"),
    ("trustpilot", "r2", "Texte ambigu", True, "non_classe", "heuristic"),
    ("trustpilot", "r3", "   ", False, "non_classe", "heuristic"),
    ("app_store", "r1", "déjà classé", True, "app_fr", "heuristic"),
]


def failing_scorer():
    """A local function, so that workers get its code."""

    def score(prompts: pd.Series) -> pd.Series:
        if any("ambigu" in p for p in prompts):
            raise ConnectionError("model is down")
        return pd.Series(['{"category": "communication_hote", "confidence": 0.9}'] * len(prompts))

    return score


def test_scoring_survives_failures_and_touches_candidates_only(spark):
    scorer = failing_scorer()
    table = raw(spark, ROWS)
    found = verdicts.classify_candidates(table, scorer)
    assert [tuple(r) for r in found.collect()] == [("trustpilot", "r1", "communication_hote", 0.9)]
    stats = verdicts.verdict_stats(table, found).first().asDict()
    assert stats == {"candidates": 2, "updated": 1, "skipped": 1}

    merged = {(r.source_code, r.source_review_id): r for r in verdicts.apply_verdicts(table, found).collect()}
    inline = {(r.source_code, r.source_review_id): r for r in verdicts.reclassify(table, scorer).collect()}
    assert merged == inline
    assert merged["trustpilot", "r1"].category_code == "communication_hote"
    assert merged["trustpilot", "r1"].category_source == "llm"
    assert merged["trustpilot", "r2"].category_source == "heuristic"
    assert merged["app_store", "r1"].category_code == "app_fr"

    # A second pass finds nothing left that the model could change.
    again = verdicts.apply_verdicts(verdicts.apply_verdicts(table, found), found)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.values()))


def test_model_switched_off(spark):
    stats = verdicts.verdict_stats(raw(spark, ROWS), None).first().asDict()
    assert stats == {"candidates": 0, "updated": 0, "skipped": 0}


def test_prompt(spark):
    df = spark.createDataFrame([('  dit """ceci"""  ',), ("  ",), (None,)], "text string")
    got = [r[0] for r in df.select(verdicts.prompt(F.col("text"))).collect()]
    assert got[0].endswith('Avis à classer :\n"""dit "ceci\""""\n\nJSON :')
    assert all(f"- {code}: " in got[0] for code in tx.MODEL_CATEGORIES)
    assert got[1:] == [None, None]


def hanging_scorer():
    def score(prompts: pd.Series) -> pd.Series:
        if any("ambigu" in p for p in prompts):
            time.sleep(3600)
        return pd.Series(['{"category": "communication_hote", "confidence": 0.9}'] * len(prompts))

    return score


def test_a_prompt_that_hangs_costs_its_own_verdict_only(spark):
    rows = [("trustpilot", f"r{i}", f"Texte numéro {i}", True, "non_classe", "heuristic") for i in range(40)]
    rows[7] = ("trustpilot", "r7", "Texte ambigu", True, "non_classe", "heuristic")
    table = raw(spark, rows).coalesce(1)
    limits = verdicts.Limits(seconds=1.0, batch=16, at_once=4)
    began = time.monotonic()
    found = verdicts.classify_candidates(table, hanging_scorer(), limits).collect()
    assert {r.source_review_id for r in found} == {f"r{i}" for i in range(40)} - {"r7"}
    inline = verdicts.reclassify(table, hanging_scorer(), limits).where("category_source = 'heuristic'")
    assert [r.source_review_id for r in inline.collect()] == ["r7"]
    assert time.monotonic() - began < 60
