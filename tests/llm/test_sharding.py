"""Differencing shards: balance, groups kept together, gapless slots."""

import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from weftbook.llm import sharding
from weftbook.llm.queries import QUERIES


def check(rows, docs, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d is None, d or 0) for d, _ in docs)
    by_shard, texts = defaultdict(list), defaultdict(set)
    by_id = dict(docs)
    for r in rows:
        raw = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by_shard[r.shard].append(r)
        texts[raw].add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    assert set(by_shard) <= set(range(shards))
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    return [sum(r.size for r in by_shard.get(s, [])) for s in range(shards)]


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sums = check(QUERIES["op10_differencing_shards"](spark, sf_dir).collect(), docs, 16)
    groups = defaultdict(int)
    for _, t in docs:
        groups[t] += len((t or "").encode()) + 1
    assert max(sums) - min(sums) <= max(groups.values())
    assert max(sums) <= max(max(groups.values()), 1.02 * sum(sums) / 16)


def test_hand_made(spark):
    docs = [(1, None), (2, ""), (3, "é"), (4, "same"), (5, "same"), (6, "x" * 90000), (None, "no id")] + [
        (100 + i, "w" * (i % 37) + str(i)) for i in range(300)
    ]
    frame = spark.createDataFrame([(d, t, 1, "a") for d, t in docs], "doc_id long, text string, shard int, size string")
    sums = check(sharding.shard(frame, 4).collect(), docs, 4)
    assert sorted(sums)[-1] == 90001  # the text larger than all others together stands alone
    assert sorted(sums)[2] - sorted(sums)[0] <= 2


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(1, 6))
def test_differencing_bounds(sizes, parts):
    place = sharding.differencing(sizes, parts)
    assert len(place) == len(sizes) and all(0 <= p < parts for p in place)
    sums = [0] * parts
    for size, p in zip(sizes, place):
        sums[p] += size
    assert max(sums) - min(sums) <= max(sizes, default=0)


def test_differencing_beats_greedy_on_the_classic_case():
    sums = [0, 0]
    for size, p in zip([8, 7, 6, 5, 4], sharding.differencing([8, 7, 6, 5, 4], 2)):
        sums[p] += size
    assert abs(sums[0] - sums[1]) == 2
