"""Rule-based intent of chat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keyquarry import rules
from keyquarry.functions.text import any_of, first_match

_UUID = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def classify_intent(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds intent, confidence, the parameters that intent uses, and ``needs_review``.

    The first intent with a matching word wins.  ``needs_review`` marks messages the
    rules are not sure about (confidence 0.8 or less).
    """
    lower = F.lower(F.col(text))
    intent = F.lit("unknown")
    for name, words in reversed(rules.INTENT_WORDS):
        hit = any_of(lower, words)
        if name == "help":
            hit = hit | (F.col(text) == "?")
        intent = F.when(hit, F.lit(name)).otherwise(intent)
    i = F.col("intent")
    uuid = F.nullif(F.regexp_extract(F.col(text), _UUID, 0), F.lit(""))
    return (
        messages.withColumn("intent", intent)
        .withColumn(
            "confidence",
            F.when(i == "help", F.lit(1.0)).when(i == "unknown", F.lit(0.3)).otherwise(F.lit(0.9)),
        )
        .withColumn("service", F.when(i.isin("provision_secret", "rotate_secret"),
                                      first_match(lower, [(s, [s]) for s in rules.INTENT_SERVICES])))
        .withColumn("environment", F.when(i.isin("provision_secret", "list_secrets"),
                                          first_match(lower, rules.INTENT_ENVIRONMENTS)))
        .withColumn("secret_id", F.when(i == "rotate_secret", uuid))
        .withColumn("framework", F.when(i == "check_compliance", first_match(lower, rules.INTENT_FRAMEWORKS)))
        .withColumn("needs_review", F.col("confidence") <= 0.8)
    )
