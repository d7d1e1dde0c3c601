"""Near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from weftbook.llm import near_dedup
from weftbook.llm.components import components
from weftbook.llm.queries import QUERIES


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs):
    """(doc_id, n_shingles, component_id, kept) of rows with unique ids."""
    sets = {d: shingles(t) for d, t in docs}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = {}
        for x in s:
            for other in where[x]:
                if other > d:
                    shared[other] = shared.get(other, 0) + 1
        for other, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[other]) - n):
                a, b = sorted((find(d), find(other)))
                parent[b] = a
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op9_odd_sketches"](spark, folder).collect()) == brute(docs)


def test_groups_chains_and_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    docs = [(i, None if i % 2 else " \n") for i in range(4)]
    for i in range(60):  # a group of near copies of one text, and steps that drift away from it
        changed = list(base)
        for _ in range(rng.randrange(3)):
            changed[rng.randrange(200)] = word()
        docs.append((100 + i, " ".join(changed)))
    drift = list(base)
    for i in range(30):
        drift[(i * 7) % 200] = word()
        docs.append((200 + i, " ".join(drift)))
    core = [word() for _ in range(120)]
    for i in range(150):  # a group around the threshold: some linked with many, some with few or none
        changed = list(core)
        for _ in range(rng.randrange(1, 5)):
            changed[rng.randrange(120)] = word()
        docs.append((1000 + i, " ".join(changed)))
    passage = " ".join(word() for _ in range(60))
    docs += [(300 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(40)]
    docs += [(400, "One two"), (401, "oNE\tTWO"), (402, "one two three"), (403, "a b c d e"), (404, "A b  c d E"), (405, "é à"), (406, "É à")]
    docs += [(500 + i, " ".join(base[:50]) + " " + "z" * 50000) for i in range(2)]
    frame = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, n int, key string")
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(frame).collect()) == brute(docs)
    kept = near_dedup.drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _, _, k in brute(docs) if k]


def test_null_ids_repeats_and_empty_tables(spark):
    text = "some words that are long enough to make shingles of"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (3, text), (9, "")], "doc_id long, text string")
    rows = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=repr)
    assert rows == sorted([(None, 6, None, True), (7, 6, 3, False), (7, 6, 3, False), (3, 6, 3, True), (9, 0, 9, True)], key=repr)
    assert near_dedup.near_duplicates(docs.filter("false")).count() == 0


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(2)
    for similarity in (0.75, 0.9):
        apart = []
        for _ in range(60):
            common = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            rest = round(1000 * (1 - similarity) / similarity / 2)
            sides = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rest, dtype=np.uint64)])) for _ in range(2)]
            a, b = (near_dedup.odd_sketch(near_dedup.samples(s)) for s in sides)
            apart.append(sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)))
        assert abs(np.mean(apart) - near_dedup.bits_apart(similarity)) < 6
        assert max(apart) <= near_dedup.bits_apart(near_dedup.SIFT)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (60, 59), (60, 59)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in components(frame).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {59: 59, 60: 59}
    assert components(frame.filter("false")).count() == 0


def test_dropped_copies_with_null_and_repeated_ids(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, base), (9, base + " "), (9, "other words of the same number nine"), (None, base), (None, "x"), (5, "y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in near_dedup.drop_near_copies(docs).collect()}
    assert kept == set(rows) - {(9, base + " ")}


def test_low_similarities_are_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 50)
