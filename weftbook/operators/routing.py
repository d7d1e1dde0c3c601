"""Questions sorted by the intent their words show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules in order; the first rule with a word in the question wins.
RULES = (
    ("benchmark", ("sam", "smv", "operation")),
    ("costing", ("cost", "cm", "costing", "fob")),
    ("fabric", ("fabric", "structure", "jersey", "hoodie")),
)
FALLBACK = "fallback"

# Anything but white space, as a browser's trim sees it.
_INK = r"[^\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def intent_of(text: Column, rules=RULES, fallback: str = FALLBACK) -> Column:
    """Intent of a question: plain parts of words count, case does not."""
    lowered = F.lower(text)
    chain = None
    for intent, words in rules:
        hit = reduce(lambda a, b: a | b, [lowered.contains(word) for word in words])
        chain = F.when(hit, intent) if chain is None else chain.when(hit, intent)
    return F.lit(fallback) if chain is None else chain.otherwise(fallback)


def route(questions: DataFrame, rules=RULES, fallback: str = FALLBACK, text: str = "text") -> DataFrame:
    """Add ``intent``; blank questions are left out."""
    return questions.where(F.col(text).rlike(_INK)).withColumn("intent", intent_of(F.col(text), rules, fallback))


def intent_summary(questions: DataFrame, rules=RULES, fallback: str = FALLBACK, text: str = "text") -> DataFrame:
    return route(questions, rules, fallback, text).groupBy("intent").agg(F.count(F.lit(1)).alias("questions"))
