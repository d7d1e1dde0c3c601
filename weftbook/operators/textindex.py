"""Keyword search by a stored index of trigrams.

Every published item is indexed under the distinct trigrams of its lower-cased searched fields.  The items are stored first, by kind
and block of ids and sorted by id; postings are made of the stored items, a run of texts at a time: numbers for the trigrams
of the run, one sort, no row per trigram and item.  A posting is one row per trigram, kind, block and run, with the sorted places of
its items in the block, so a trigram that all items hold is spread over many bounded rows.  Postings are stored by bucket of
the trigram and by kind.

A search takes the trigrams of the query's literal parts (what stands between wildcards), reads the postings of those only,
intersects them block by block, and confirms the candidates, read from their blocks, by the same ILIKE as the scan: the first NEAR by id
before all others, as a search shows the first hits by id.  Where these do not give all hits, all candidates are confirmed.  Queries
without three literal characters in a row read all items of the kind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feeds import first_n, published
from .search import HITS, SEARCHED, TABLE_OF, matches

BUCKETS = 256
BLOCK_BITS = 18  # ids of one block: at most 1 MB of them in a posting
GRAM = 3
RUN_CHARS = 4_000_000  # texts that are sorted together; longer ones are cut
GROUP_BYTES = 16 << 20  # row groups of the items: what a search reads around a hit, and a task that makes postings
FILES = 8  # tasks that write one bucket of a kind, each some blocks
KEYS = 1 << 62  # numbers for trigram and item
NEAR = 1000  # candidates that are confirmed before all others
POSTINGS = "gram string, block bigint, places array<int>, bucket int, kind string"
RUN = pa.schema([("gram", pa.string()), ("block", pa.int64()), ("places", pa.list_(pa.int32()))])


def _postings(ids: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """gram, block and places of some texts; ``ids`` are the items they belong to."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if not len(codes):
        return
    met = np.zeros(int(codes.max()) + 1, bool)
    met[codes] = True
    alphabet = np.nonzero(met)[0]
    items, item = np.unique(ids, return_inverse=True)
    letters, count = len(alphabet), len(items)
    if letters**GRAM * count >= KEYS and len(texts) > 1:  # numbers would not fit
        middle = len(texts) // 2
        yield from _postings(ids[:middle], texts[:middle])
        yield from _postings(ids[middle:], texts[middle:])
        return
    number = (np.cumsum(met) - 1)[codes]
    ends = np.cumsum(sizes)
    whole = np.ones(len(codes) + GRAM, bool)  # no trigram crosses the end of a text
    for k in range(1, GRAM):
        whole[np.maximum(ends - k, 0)] = False
    key = number[: max(len(codes) - GRAM + 1, 0)]
    for k in range(1, GRAM):
        key = key * letters + number[k : len(codes) - GRAM + 1 + k]
    whole = whole[: len(key)]
    key = key[whole] * count + np.repeat(item, sizes)[: len(key)][whole]
    if not len(key):
        return
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    gram, held = key // count, items[key % count]
    block = held >> BLOCK_BITS
    first = np.nonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])]))[0]
    gram = gram[first]
    spelt = alphabet[np.stack([gram // letters**k % letters for k in reversed(range(GRAM))], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([spelt[i : i + GRAM] for i in range(0, len(spelt), GRAM)], pa.string()),
            pa.array(block[first]),
            pa.ListArray.from_arrays(
                pa.array(np.append(first, len(held)).astype(np.int32)), pa.array((held & ((1 << BLOCK_BITS) - 1)).astype(np.int32))
            ),
        ],
        schema=RUN,
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of a task's items (id and lower-cased fields), run by run."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        owners = batch.column(0).to_pylist()
        for field in batch.columns[1:]:
            for owner, text in zip(owners, field):
                text = text.as_py() or ""
                for at in range(0, max(len(text) - GRAM + 1, 0), RUN_CHARS):
                    ids.append(owner)
                    texts.append(text[at : at + RUN_CHARS + GRAM - 1])
                    chars += len(texts[-1])
                    if chars >= RUN_CHARS:
                        yield from _postings(np.array(ids, np.int64), texts)
                        ids, texts, chars = [], [], 0
    if texts:
        yield from _postings(np.array(ids, np.int64), texts)


def _bucket(gram: str, buckets: int) -> int:
    return zlib.crc32(gram.encode()) % buckets


def postings_of(kind: str, items: DataFrame) -> DataFrame:
    """gram, kind, block and sorted places (the id's last BLOCK_BITS) of all published items of a kind that have an id.

    A trigram may have several rows per block.
    """
    texts = published(items).where("id IS NOT NULL").select(F.col("id").cast("bigint"), *[F.lower(F.col(f)).alias(f) for f in SEARCHED[kind]])
    return texts.mapInArrow(_runs, "gram string, block bigint, places array<int>").withColumn("kind", F.lit(kind))


def write_index(tables, root: str, buckets: int = BUCKETS, kinds: tuple[str, ...] = tuple(SEARCHED)) -> None:
    """Index the tables of a catalogue object below ``root``."""
    rows = []
    for kind in kinds:
        items = published(getattr(tables, TABLE_OF[kind])).withColumn("block", F.shiftright(F.col("id").cast("bigint"), BLOCK_BITS))
        sorted_items = items.repartitionByRange("block", "id").sortWithinPartitions("block", "id")
        sorted_items.write.option("parquet.block.size", GROUP_BYTES).partitionBy("block").parquet(f"{root}/items/{kind}")
        rows.append(postings_of(kind, items.sparkSession.read.schema(items.schema).parquet(f"{root}/items/{kind}")))
    rows = reduce(DataFrame.unionByName, rows).withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).cast("int"))
    (
        rows.repartition("bucket", "kind", F.pmod("block", F.lit(FILES)))
        .sortWithinPartitions("bucket", "kind", "gram", "block")  # few row groups hold a trigram
        .write.partitionBy("bucket", "kind")
        .parquet(f"{root}/postings")
    )


def literal_parts(pattern: str) -> list[str]:
    """The parts of a search text between wildcards; a backslash makes ``%``, ``_`` and itself literal."""
    tokens = re.findall(r"\\[%_\\]|.", pattern, re.DOTALL)
    text = "".join("\0" if t in "%_" else t[-1] for t in tokens)
    return [part for part in text.split("\0") if part]


def query_grams(spark: SparkSession, query: str) -> list[str]:
    """The trigrams that every match must hold; lower-cased as the engine does it."""
    lowered = spark.range(1).select(F.lower(F.lit(query.replace("\0", " ")))).first()[0]
    return sorted({part[i : i + GRAM] for part in literal_parts(lowered) for i in range(len(part) - GRAM + 1)})


class TextIndex:
    """The index that ``write_index`` stored below ``root`` with the same number of buckets."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.postings = spark.read.schema(POSTINGS).parquet(f"{root}/postings")
        self._items: dict[str, DataFrame] = {}

    def items(self, kind: str) -> DataFrame:
        """The published items of a kind, with the block of their id."""
        if kind not in self._items:
            self._items[kind] = self.spark.read.parquet(f"{self.root}/items/{kind}").withColumn("block", F.col("block").cast("bigint"))
        return self._items[kind]

    def candidates(self, kind: str, grams: list[str]) -> DataFrame:
        """block and id of the items that hold all of ``grams``."""
        asked = F.col("bucket").isin(sorted({_bucket(g, self.buckets) for g in grams})) & (F.col("kind") == kind)
        held = self.postings.where(asked & F.col("gram").isin(grams))
        each = held.groupBy("block", "gram").agg(F.flatten(F.collect_list("places")).alias("places"))
        # One list per trigram of the query: the query's length bounds the group.
        met = each.groupBy("block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(grams))
        shared = F.aggregate(F.slice("lists", 2, len(grams)), F.array_distinct(F.element_at("lists", 1)), F.array_intersect)
        return met.select("block", F.explode(shared).alias("place")).select(
            "block", (F.shiftleft("block", BLOCK_BITS) + F.col("place")).alias("id")
        )

    def search(self, kind: str, query: str, hits: int = HITS) -> DataFrame:
        """The rows that ``search.keyword_search`` gives."""
        query = query.strip()
        items = self.items(kind)
        grams = query_grams(self.spark, query) if query else []
        if grams:
            items = self._held(kind, items, query, grams, hits)
        found = matches(items, SEARCHED[kind], query) if query else items.where(F.lit(False))
        return first_n(found.drop("block"), hits)

    def _held(self, kind: str, items: DataFrame, query: str, grams: list[str], hits: int) -> DataFrame:
        """Items that hold all of ``grams``; where the first NEAR by id give all hits, the hits alone."""
        candidates = self.candidates(kind, grams)
        ids = [row.id for row in candidates.select("id").orderBy("id").limit(NEAR).collect()]
        near = _among(items, ids)
        if len(ids) < NEAR:  # there are no others
            return near
        found = first_n(matches(near, SEARCHED[kind], query), hits).select("id").collect()
        if len(found) == hits:
            return _among(items, [row.id for row in found])
        return items.join(candidates, ["block", "id"], "left_semi")


def _among(items: DataFrame, ids: list[int]) -> DataFrame:
    """The items with some ids, from their blocks."""
    return items.where(F.col("block").isin(sorted({i >> BLOCK_BITS for i in ids})) & F.col("id").isin(sorted(set(ids))))
