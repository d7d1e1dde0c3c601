"""Trie deduplication: against SQL, with hand-made cases, and with budgets that force spilling."""

import hashlib
import re

import pytest
from compare import database, differences
from hypothesis import given, settings
from hypothesis import strategies as st

from weftbook.llm import exact_dedup
from weftbook.llm.queries import ORACLE, QUERIES


def test_whole_table(spark, sf_dir):
    assert differences(QUERIES["op4_trie_dedup"](spark, sf_dir), database(sf_dir), ORACLE["op4_trie_dedup"]) == []


def brute(rows):
    bare = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, (_, t) in enumerate(rows)}
    out = []
    for i, (doc, _) in enumerate(rows):
        group = [j for j in bare if bare[j] == bare[i]]
        best = min(group, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        keep = rows[best][0]
        out.append((doc, keep, len(group), doc == keep, hashlib.sha256(bare[i].encode()).hexdigest()))
    return sorted(out, key=repr)


CASES = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "a b"), (8, "é"), (9, "é"),
    (10, "x" * 70000), (11, "x" * 70000 + " "), (12, "x" * 69999), (None, "null id"), (None, "null id"), (13, "twice"), (13, "twice"),
    (14, "A b"), (15, "\x1cab"), (16, "ab "), (17, "abc"), (18, "abcd"), (19, "abd"),
]


@pytest.mark.parametrize("budget", [2000, 1 << 26])
def test_hand_made(spark, budget):
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in CASES], "doc_id long, text string, keep_id string, n int")
    found = exact_dedup.exact_dedup(docs, budget)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(CASES)


def test_drop_copies_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "u"), (2, "ab", "v"), (3, "c", None)], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in exact_dedup.drop_copies(docs).collect()) == [(1, "a b", "u"), (3, "c", None)]


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=40), st.integers(1, 2000))
def test_trie_counts_every_text_once(texts, budget):
    trie = exact_dedup.PatriciaTrie(budget)
    for i, t in enumerate(texts):
        trie.insert(t, exact_dedup.Owner(b"", 0, i, 1))
    final = {t: (o.n, o.doc) for t, o in trie.terminals()}
    spilled = {}
    for t, o in trie.overflow:
        n, doc = spilled.get(t, (0, 1 << 62))
        spilled[t] = (n + o.n, min(doc, o.doc))
    assert not set(final) & set(spilled)
    assert final or not texts
    assert final | spilled == {t: (texts.count(t), texts.index(t)) for t in set(texts)}


def test_dropped_copies_with_null_and_repeated_ids(spark):
    rows = [
        (5, "a longer original text"), (None, "alonger original text"), (None, "another text"), (7, "x y"), (8, "xy"),
        (8, "unrelated words here"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in exact_dedup.drop_copies(docs).collect()}
    assert kept == {(5, "a longer original text"), (None, "another text"), (7, "x y"), (8, "unrelated words here")}
