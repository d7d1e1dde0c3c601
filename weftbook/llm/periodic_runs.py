"""Periodic runs of words in every document, by suffix trees of the document and of its reversal.

A run is a longest stretch whose words repeat at a smallest distance q (its period) and that holds at least LEAST words
and two periods.  Every run holds a Lyndon root, for one of the two orders of the words: the longest Lyndon word at some place, which
ends before the next smaller suffix.  So each place gives one candidate (place, period) for each order.  A candidate is
extended to both sides by longest common extensions: string depths of lowest common ancestors in Ukkonen's suffix trees of the
words and of the reversed words, found as minima over Euler tours.  The queries of all candidates of a tour are answered level
by level of its sparse table, so that only one level is held.

Before that, words that can be in no run are cut out, exactly: in a run of period q and at least max(LEAST, 2q) words, LEAST = 12, each
word lies in a stretch of SHINGLE = 6 words that occurs again q words further or earlier in the run.  So what no repeated
shingle covers is in no run, also when repeats are only looked for within the stretches left; this is done until nothing more goes.
Every gap becomes one word that occurs nowhere else.

Documents meet no other row: this is one narrow pass over the table, and a worker holds the trees of one document.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftbook.llm.common import text_runs

LEAST = 12
SHINGLE = 6  # LEAST // 2: see above
CHUNK_CHARS = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class SuffixTree:
    """Ukkonen's tree of a sequence of numbers whose last one occurs nowhere else; node 0 is the root."""

    def __init__(self, codes: list[int]):
        n = self.size = len(codes)
        self.width = width = max(codes) + 1
        self.child: dict[int, int] = {}  # node * width + first number of the edge -> node below
        child = self.child
        start, end = array("q", [0]), array("q", [0])  # the edge that leads to a node: codes[start:end]
        link, parent, suffix = array("q", [0]), array("q", [0]), array("q", [-1])
        node = edge = length = left = leaves = 0
        for i, code in enumerate(codes):
            left += 1
            last = 0  # inner node of this phase that has no suffix link yet
            while left:
                if not length:
                    edge = i
                key = node * width + codes[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i), end.append(n), link.append(0), parent.append(node), suffix.append(leaves)
                    leaves += 1
                    if last:
                        link[last] = node
                        last = 0
                else:
                    first = start[below]
                    extent = (i + 1 if suffix[below] >= 0 else end[below]) - first
                    if length >= extent:  # walk down
                        edge += extent
                        length -= extent
                        node = below
                        continue
                    if codes[first + length] == code:
                        if last:
                            link[last] = node
                        length += 1
                        break
                    middle = len(start)
                    child[key] = middle
                    start.append(first), end.append(first + length), link.append(0), parent.append(node), suffix.append(-1)
                    start[below], parent[below] = first + length, middle
                    child[middle * width + codes[first + length]] = below
                    child[middle * width + code] = middle + 1
                    start.append(i), end.append(n), link.append(0), parent.append(middle), suffix.append(leaves)
                    leaves += 1
                    if last:
                        link[last] = middle
                    last = middle
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.start, self.end, self.parent, self.suffix = (np.array(a) for a in (start, end, parent, suffix))

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Euler tour in order of the numbers: string depth of every visit, visit of every suffix's leaf, rank of every suffix."""
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        nodes = np.fromiter(self.child.values(), np.int64, len(self.child))
        order = np.argsort(keys)
        owners, below = keys[order] // self.width, nodes[order]
        borders = np.searchsorted(owners, np.arange(len(self.start) + 1)).tolist()
        below = below.tolist()
        sizes = (self.end - self.start).tolist()
        suffix = self.suffix.tolist()
        depths = array("q", [0])
        depth = array("q", bytes(8 * len(sizes)))
        visit, rank = array("q", bytes(8 * self.size)), array("q", bytes(8 * self.size))
        stack, at, seen = [0], array("q", borders[:-1]), 0
        while stack:
            node = stack[-1]
            if at[node] == borders[node + 1]:
                stack.pop()
                if stack:
                    depths.append(depth[stack[-1]])
                continue
            down = below[at[node]]
            at[node] += 1
            depth[down] = depth[node] + sizes[down]
            leaf = suffix[down]
            if leaf >= 0:
                visit[leaf], rank[leaf] = len(depths), seen
                seen += 1
                depths.append(depth[down])
                depths.append(depth[node])
            else:
                depths.append(depth[down])
                stack.append(down)
        return np.array(depths), np.array(visit), np.array(rank)


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high] for every query (none empty): two entries of one level of the sparse table each."""
    found = np.empty(len(low), values.dtype)
    level_of = np.frexp((high - low).astype(np.float64))[1] - 1
    level, width = values, 1
    for k in range(int(level_of.max(initial=-1)) + 1):
        if k:
            level = np.minimum(level[: len(level) - width], level[width:])
            width *= 2
        mine = np.flatnonzero(level_of == k)
        found[mine] = np.minimum(level[low[mine]], level[high[mine] - width])
    return found


def next_smaller(ranks: list[int]) -> np.ndarray:
    """Place of the next smaller value behind every place, or the end."""
    found = array("q", bytes(8 * len(ranks)))
    stack: list[int] = []
    for i, rank in enumerate(ranks):
        while stack and ranks[stack[-1]] > rank:
            found[stack.pop()] = i
        stack.append(i)
    for i in stack:
        found[i] = len(ranks)
    return np.array(found)


def extensions(tour: tuple[np.ndarray, np.ndarray, np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many numbers the suffixes that start at ``one`` and ``two`` (never the same) share."""
    depths, visit, _ = tour
    a, b = visit[one], visit[two]
    return range_minima(depths, np.minimum(a, b), np.maximum(a, b) + 1)


def find_runs(codes: list[int], least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``least`` numbers, by start, then period."""
    n = len(codes)
    end = max(codes, default=0) + 1
    forward = SuffixTree([*codes, end]).tour()
    places = np.arange(n)
    starts, periods = [], []
    ranks = forward[2][:n]
    for order in (ranks, -ranks):
        size = next_smaller(order.tolist()) - places
        keep = places + size < n
        starts.append(places[keep])
        periods.append(size[keep])
    start, period = np.concatenate(starts), np.concatenate(periods)
    ahead = extensions(forward, start, start + period)
    del forward
    backward = SuffixTree([*codes[::-1], end]).tour()
    back = np.zeros(len(start), np.int64)
    inner = np.flatnonzero(start > 0)
    back[inner] = extensions(backward, n - start[inner], n - start[inner] - period[inner])
    length = back + period + ahead
    keep = length >= np.maximum(least, 2 * period)
    return np.unique(np.stack([start - back, period, length], 1)[keep], axis=0)[:, [0, 2, 1]]


def candidates(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may be in a run, and the stretch of each; ``words``: 64-bit hashes, ``owner``: document."""
    places, stretch = np.arange(len(words)), owner.astype(np.uint64)
    while True:
        before = len(places)
        if before < LEAST:
            return places[:0], stretch[:0]
        here = words[places]
        mixed = np.zeros(before - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX + here[i : before - SHINGLE + 1 + i]
        mixed += stretch[: len(mixed)] * MIX
        inside = stretch[: len(mixed)] == stretch[SHINGLE - 1 :]
        asked = np.sort(mixed[inside])
        twice = np.unique(asked[1:][asked[1:] == asked[:-1]])
        if not len(twice):
            return places[:0], stretch[:0]
        where = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
        begins = np.flatnonzero(inside & (twice[where] == mixed))
        covered = np.zeros(before + 1, np.int64)
        covered[begins] += 1
        covered[begins + SHINGLE] -= 1
        left = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
        places, old = places[left], stretch[left]
        fresh = np.ones(len(places), bool)
        fresh[1:] = (np.diff(places) != 1) | (old[1:] != old[:-1])
        stretch = np.cumsum(fresh).astype(np.uint64)
        long = np.bincount(stretch.astype(np.int64))[stretch.astype(np.int64)] >= LEAST
        places, stretch = places[long], stretch[long]
        if len(places) == before:
            return places, stretch


def runs_of(words: list[bytes], places: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of one document's runs, from the places of the words that may be in one."""
    if not len(places):
        return np.empty((0, 3), np.int64)
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(words[p], len(numbers)) for p in places.tolist()], np.int64)
    gaps = np.flatnonzero(stretch[1:] != stretch[:-1]) + 1
    marks = len(numbers) + np.arange(len(gaps))
    found = find_runs(np.insert(codes, gaps, marks).tolist())
    found[:, 0] = np.insert(places, gaps, -1)[found[:, 0]]
    return found


def collapse(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without those that any run contains after its first period, joined by one blank."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """All runs of every row of ``docs`` (doc_id, text; others are ignored): doc_id, n_words, runs, collapsed.

    Words are what stands between blanks, tabs and line ends.  ``runs``: start (number of the first word, from 0), length and
    period in words, by start, then period.  ``collapsed``: the words that no run contains after its first period, joined by one blank.
    Null and empty texts have no words and no runs; repeated rows and null doc_ids are rows like any other; texts of any
    length are read whole (trees take some hundred bytes for every word that may be in a run); an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_runs(batches, CHUNK_CHARS):
            split = [t.encode().split() for t in texts]
            sizes = np.array([len(w) for w in split])
            first = np.cumsum(sizes) - sizes
            hashes = np.fromiter(map(hash, chain.from_iterable(split)), np.int64, int(sizes.sum())).astype(np.uint64)
            places, stretch = candidates(hashes, np.repeat(np.arange(len(split)), sizes))
            borders = np.searchsorted(places, np.append(first, len(hashes)))
            found = [
                runs_of(words, places[low:high] - at, stretch[low:high])
                for words, at, low, high in zip(split, first.tolist(), borders[:-1].tolist(), borders[1:].tolist())
            ]
            rows = np.concatenate(found)
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(rows[:, i], pa.int64()) for i in range(3)], fields=list(RUN)),
            )
            collapsed = pa.array([collapse(w, f) for w, f in zip(split, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists.cast(pa.list_(RUN)), collapsed], schema=FOUND
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(work, SCHEMA)


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic end in about a tenth of the texts; the doc_id decides where and with what period.

    With h the CRC-32 of the doc_id's digits, g = h div 10 and n words: if h mod 10 is 0, word i >= a becomes word a + (i - a) mod p,
    where a = g mod n and p = 1 + (n - a) div (3 + g mod 8).  Texts without words and rows without doc_id stay as they are.
    """
    hashed = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    rows = docs.withColumn("_hash", hashed).withColumn("_words", F.when(F.col("_hash") % 10 == 0, words))
    n, g = F.size("_words").cast("long"), F.floor(F.col("_hash") / 10)
    a = F.when(n > 0, g % n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    rows = rows.withColumn("_at", a).withColumn("_period", p)

    def word(w: Column, i: Column) -> Column:
        moved = F.col("_at") + (i - F.col("_at")) % F.col("_period")
        return F.when(i < F.col("_at"), w).otherwise(F.get("_words", moved.cast("int")))

    repeated = F.array_join(F.transform("_words", word), " ")
    return rows.withColumn("text", F.when(F.col("_at").isNotNull(), repeated).otherwise(F.col("text"))).select(docs.columns)


def run_digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the greatest one and digests of all runs and of the collapsed text."""
    negated = F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p")))
    best = F.array_min(negated)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    lines = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.withColumn("_best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.s").alias("start"),
        (-F.col("_best.l")).alias("length"),
        F.col("_best.p").alias("period"),
        F.floor(-1000 * F.col("_best.l") / F.col("_best.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
