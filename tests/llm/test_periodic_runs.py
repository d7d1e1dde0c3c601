"""Runs against a brute-force search, trees and minima against their definitions, planted repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftbook.llm import periodic_runs
from weftbook.llm.queries import QUERIES


def brute(words, least=12):
    """All runs by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            start, length = i, end + q - i
            i = end + 1
            if length < max(least, 2 * q):
                continue
            part = words[start : start + length]
            if not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc, text):
    """The words of a document as the query sees them."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def expected(doc, text):
    words = planted(doc, text)
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=45), st.integers(1, 6))
def test_runs_of_small_alphabets(codes, least):
    found = [tuple(r) for r in periodic_runs.find_runs(codes, least).tolist()] if codes else []
    assert found == brute(codes, least)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_runs_behind_the_filter(seed):
    """Whole documents through the filter of repeated shingles, several at once."""
    rng = random.Random(seed)
    docs = []
    for _ in range(rng.randrange(1, 5)):
        words = []
        for _ in range(rng.randrange(6)):
            part = [str(rng.randrange(rng.choice([1, 2, 3, 30]))) for _ in range(rng.randrange(1, 9))]
            words += (part * rng.randrange(1, 8))[: rng.randrange(1, 40)]
        docs.append([w.encode() for w in words])
    hashes = np.array([hash(w) for words in docs for w in words], np.int64).astype(np.uint64)
    sizes = [len(w) for w in docs]
    places, stretch = periodic_runs.candidates(hashes, np.repeat(np.arange(len(docs)), sizes))
    at = 0
    for words, size in zip(docs, sizes):
        mine = (places >= at) & (places < at + size)
        found = periodic_runs.runs_of(words, places[mine] - at, stretch[mine])
        assert [tuple(r) for r in found.tolist()] == brute(words)
        at += size


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=40))
def test_tree_extensions(codes):
    codes = [*codes, 3]
    tour = periodic_runs.SuffixTree(codes).tour()
    n = len(codes)
    order = sorted(range(n), key=lambda i: codes[i:])
    assert [int(r) for r in tour[2][order]] == list(range(n))
    one, two = (np.array(x) for x in zip(*[(i, j) for i in range(n) for j in range(n) if i != j]))
    for i, j, found in zip(one, two, periodic_runs.extensions(tour, one, two)):
        shared = 0
        while max(i, j) + shared < n and codes[i + shared] == codes[j + shared]:
            shared += 1
        assert found == shared


@pytest.mark.parametrize("words", [["a"] * 3000, ["a", "b"] * 1500, list("abaababaabaab" * 60)])
def test_long_runs(words):
    got = [tuple(r) for r in periodic_runs.find_runs([ord(w) for w in words]).tolist()]
    assert got == brute(words)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op13_suffix_tree_runs"](spark, sf_dir)
    assert rows.columns == COLUMNS
    got = {r.doc_id: tuple(r) for r in rows.collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) >= len(docs) // 20
    for doc, text in docs:
        words = planted(doc, text)
        assert hashlib.sha256(" ".join(words).encode()).hexdigest() == got[doc][-1] or got[doc][1] > 0
        if len(words) <= 1200:  # the brute-force search takes the square of that
            assert got[doc] == expected(doc, text)


def test_hand_made(spark):
    texts = [
        (1, None), (1, None), (2, ""), (3, " \t\n"), (4, "a " * 12), (5, "a " * 11), (6, "x " + "a b c d e f g\n" * 2 + "y"),
        (None, "p q " * 9 + "z"), (7, "one"), (7, "two " * 30), (8, "w\x0bw\x0cw\rw\tw  w\nw w w w w w"), (9, "a\xa0a " * 13),
        *[(doc, "the quick brown fox " * 40 + "end") for doc in range(10, 60)],
        *[(doc, " ".join(map(str, range(37)))) for doc in range(60, 160)],
    ]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, n_runs int, start string")
    found = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_repeats(docs))).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((expected(d, t) for d, t in texts), key=repr)
    plain = {r.doc_id: r for r in periodic_runs.periodic_runs(docs.filter("doc_id < 7 and doc_id > 3")).collect()}
    assert [tuple(r) for r in plain[4].runs] == [(0, 12, 1)] and plain[4].collapsed == "a" and plain[5].runs == []
    assert [tuple(r) for r in plain[6].runs] == [(1, 14, 7)] and plain[6].collapsed == "x a b c d e f g y"
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(docs.filter("false"))).count() == 0
