"""Near-duplicate documents: MinHash bands for candidates, odd sketches to sift them, full shingle sets to confirm.

1.  Every text becomes its set of hashed five-word shingles, HASHES MinHash samples of it, BANDS keys of ROWS samples each, and
    an odd sketch: each sample toggles one of BITS bits.  Texts with the same set are one class from here on.
2.  In every bucket of a band key each class is paired with the smallest one only.  The number of bits in which two sketches
    differ estimates their similarity; what is far below the threshold goes.  Each class's nearest such partner is
    confirmed on full sets first, then the other pairs that still join different components.
3.  Buckets whose members are then all in one component are settled.  In the others (few) a component with many members is
    taken as a home: its members, in blocks, meet all other members of its buckets in tasks that hold two blocks of full sets
    and give at most one link per visitor and block.  Every two members of the remaining small components are compared by
    sketch, and confirmed.  So no link is lost by pairing with one member only, and the pairs inside or around a large
    group of copies are never formed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftbook.llm.common import lookup_groups, small_batches, stored
from weftbook.llm.components import components

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = 256
BITS = 1024
SIFT = 0.55  # estimated similarity below which a pair is not looked at: over five deviations under the threshold
WORDS_KEPT = 200_000
LONG = 64  # words with more bytes are not remembered
HOME_LEAST = 16  # members of a component in one bucket, and one in HOME_SHARE of the bucket, that make it a home
HOME_SHARE = 8
HOME_BLOCK, VISITOR_BLOCK = 128, 256
COLUMNS = 1024

_random = np.random.default_rng(20240101)
_FACTORS = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_PLACES = _random.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = _random.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_BIT_SEEDS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

SIGNATURES = "doc_id long, text_key long, n_shingles long, set_hash binary, bands array<long>, sketch array<long>"
SIGNATURES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64())),
     ("sketch", pa.list_(pa.int64()))]
)
SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX_1
    x = (x ^ (x >> np.uint64(29))) * _MIX_2
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            self[word] = value
        return value


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles; the whole sequence if there are fewer words.

    Words are runs without ASCII white space, A-Z lower-cased.
    """
    words = (text or "").encode().lower().split()
    found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(hashes) > WORDS_KEPT:
        hashes.clear()
    width = min(SHINGLE, len(found))
    if not width:
        return found
    many = len(found) - width + 1
    total = np.full(many, width, np.uint64)
    for i in range(width):
        total += found[i : i + many] * _PLACES[i]
    return np.unique(_mixed(total))


def samples(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of a set that is not empty."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(short), COLUMNS):
        table = short[None, first : first + COLUMNS] * _FACTORS[:, None]
        table += _SHIFTS[:, None]
        np.minimum(least, table.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return _mixed((rows * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) + _BAND_SEEDS).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each toggles one bit."""
    places = _mixed(least.astype(np.uint64) + _BIT_SEEDS) % np.uint64(BITS)
    odd = np.bincount(places.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bits_apart(similarity: float) -> int:
    """Bits in which the sketches of sets with this similarity differ on average, rounded up."""
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * HASHES * (1 - similarity) / BITS)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            piece = batch.slice(at, 2000)
            sizes, digests, bands, sketches = [], [], [], []
            for text in piece.column(1):
                shingles = shingle_set(text.as_py(), hashes)
                sizes.append(len(shingles))
                if not len(shingles):
                    digests.append(None)
                    bands.append(None)
                    sketches.append(None)
                    continue
                least = samples(shingles)
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                bands.append(band_keys(least))
                sketches.append(odd_sketch(least))
            columns = [piece.column(0), piece.column(2), sizes, digests, bands, sketches]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, SIGNATURES_ARROW)], schema=SIGNATURES_ARROW
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            found = [shingle_set(t.as_py(), hashes).view(np.int64) for t in piece.column(1)]
            ends = np.cumsum([0] + [len(f) for f in found])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int64()))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], schema=SETS_ARROW)


def _apart(left: Column, right: Column) -> Column:
    words = BITS // 64
    return sum((F.bit_count(left[i].bitwiseXOR(right[i])) for i in range(1, words)), F.bit_count(left[0].bitwiseXOR(right[0])))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_b"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_a"))
    shared = F.size(F.array_intersect("_a", "_b"))
    enough = shared * 100 >= (F.size("_a") + F.size("_b") - shared) * percent
    # The sizes alone rule most wrong pairs out before any sets are compared.
    possible = F.least(F.size("_a"), F.size("_b")) * 100 >= F.greatest(F.size("_a"), F.size("_b")) * percent
    return pairs.join(right, "b").join(left, "a").filter(possible).filter(enough).select("a", "b")


def _meet(percent: int):
    """Partition function for one block of a home and one of its visitors: each visitor's best link, if it has one."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        home, visitors = frame[~frame["visits"]], frame[frame["visits"]]
        out = []
        if len(home) and len(visitors):
            sets = list(home["shingles"])
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
            nodes = home["node"].to_numpy()
            for node, shingles in zip(visitors["node"], visitors["shingles"]):
                first, last = np.searchsorted(flat, shingles, "left"), np.searchsorted(flat, shingles, "right")
                many = last - first
                places = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
                shared = np.bincount(owner[places], minlength=len(sets))
                union = sizes + len(shingles) - shared
                linked = np.nonzero(shared * 100 >= union * percent)[0]
                if len(linked):
                    out.append((node, nodes[linked[np.argmax(shared[linked] / union[linked])]]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return work


def _homes(open_members: DataFrame) -> DataFrame:
    """The large components of buckets: key, component."""
    inside = open_members.groupBy("key", "component").count()
    whole = inside.groupBy("key").agg(F.sum("count").alias("_all"))
    large = inside.join(whole, "key").filter((F.col("count") >= HOME_LEAST) & (F.col("count") * HOME_SHARE >= F.col("_all")))
    return stored(large.select("key", "component"), "home-buckets")


def _open_pairs(open_members: DataFrame, limit: int) -> DataFrame:
    """Pairs of members of one bucket, but of different components, whose sketches are near."""
    left = open_members.select("key", F.col("node").alias("a"), F.col("component").alias("_ca"), F.col("sketch").alias("_a"))
    right = open_members.select("key", F.col("node").alias("b"), F.col("component").alias("_cb"), F.col("sketch").alias("_b"))
    close = _apart(F.col("_a"), F.col("_b")) <= limit
    near = left.join(right, (left["key"] == right["key"]) & (F.col("_ca") < F.col("_cb")) & close)
    return near.select("a", "b").distinct()


def _home_links(open_members: DataFrame, large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the large components of buckets and the other members there."""
    seated = open_members.select("key", "node", "component").join(large.withColumnRenamed("component", "home"), "key")
    seated = seated.join(large.withColumn("_large", F.lit(True)), ["key", "component"], "left")
    # Of two homes in one bucket, the members of the one with the larger id visit the other.
    visits = (F.col("component") > F.col("home")) | (F.col("_large").isNull() & (F.col("component") != F.col("home")))
    seated = seated.filter(visits | (F.col("component") == F.col("home"))).select("home", "node", visits.alias("visits"))
    seated = stored(seated.distinct(), "home-members")
    sizes = seated.groupBy("home").agg(
        F.ceil(F.count_if(~F.col("visits")) / HOME_BLOCK).cast("int").alias("_blocks"),
        F.ceil(F.count_if("visits") / VISITOR_BLOCK).cast("int").alias("_visitors"),
    ).filter("_blocks > 0 AND _visitors > 0")
    dealt = seated.join(sizes, "home")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("visits"), F.col("_visitors")).otherwise(F.col("_blocks"))).cast("int")
    every = F.sequence(F.lit(0), F.when(F.col("visits"), F.col("_blocks")).otherwise(F.col("_visitors")) - 1)
    dealt = dealt.select("home", "node", "visits", own.alias("_own"), F.explode(every).alias("_other"))
    dealt = dealt.select(
        "home", "node", "visits",
        F.when(F.col("visits"), F.col("_other")).otherwise(F.col("_own")).alias("_block"),
        F.when(F.col("visits"), F.col("_own")).otherwise(F.col("_other")).alias("_visitor"),
    )
    rows = dealt.join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node")
    links = rows.groupBy("home", "_block", "_visitor").applyInPandas(_meet(percent), "a long, b long")
    return stored(links, "near-links")


def _with_components(rows: DataFrame, column: str, name: str, found: DataFrame) -> DataFrame:
    named = found.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(named, column, "left").withColumn(name, F.coalesce(name, column))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every document's component: doc_id, n_shingles, component_id, kept; a row per row.

    Uses doc_id and text; other columns are ignored.  Null and empty texts have no shingle and are linked with nothing; rows
    without doc_id are not linked either (component_id null, kept).  Repeated rows are in one component and all kept or all
    not.  An empty table gives no rows.  Band keys miss a pair of similarity 0.75 with a probability of
    5 in a million, and less above; ``percent`` below PERCENT is refused, since bands and sketches are laid out for that.
    """
    return _grouped(docs, percent).drop("text_key")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """``near_duplicates`` with a hash of every text, ``text_key``."""
    if percent < PERCENT:
        raise ValueError(f"similarities below {PERCENT} percent are not found whole")
    texts = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = stored(texts.withColumn("text_key", _text_key()).mapInArrow(_signatures, SIGNATURES), "signatures")
    linkable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(
        linkable.groupBy("set_hash").agg(
            F.min("doc_id").alias("node"), F.count("*").alias("n"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        ),
        "shingle-classes",
    )
    members = classes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    shared = stored(members.join(buckets.select("key", "first"), "key"), "shared-buckets")
    sketches = classes.select("node", "sketch")

    # Full sets of the classes that share a bucket with another.
    involved = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = stored(
        texts.join(involved, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles array<long>"), "shingle-sets"
    )

    limit = bits_apart(SIFT)
    star = shared.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("_b")), "b")
    star = star.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("_a")), "a")
    star = star.select("a", "b", _apart(F.col("_a"), F.col("_b")).alias("apart")).filter(F.col("apart") <= limit)
    nearest = F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))
    star = stored(star.withColumn("place", nearest), "star-pairs")
    links = stored(_confirmed(star.filter("place = 1").select("a", "b"), sets, percent), "near-links")
    found = stored(components(links), "near-components")
    others = _with_components(_with_components(star.filter("place > 1"), "a", "_ca", found), "b", "_cb", found)
    others = stored(others.filter("_ca <> _cb").select("a", "b"), "star-pairs")
    if not others.isEmpty():
        links = links.unionByName(stored(_confirmed(others, sets, percent), "near-links"))
        found = stored(components(links), "near-components")

    # Buckets that still hold several components.
    placed = _with_components(shared, "node", "component", found)
    mixed = placed.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    mixed = mixed.filter("_low < _high").select("key")
    open_members = placed.join(mixed, "key").join(sketches, "node").select("key", "node", "component", "sketch")
    open_members = stored(open_members, "open-buckets")
    large = _homes(open_members)
    if not large.isEmpty():
        links = links.unionByName(_home_links(open_members, large, sets, percent))
        found = stored(components(links), "near-components")
        open_members = open_members.join(large, ["key", "component"], "left_anti").drop("component")
        open_members = stored(_with_components(open_members, "node", "component", found), "open-buckets")
    near = stored(_open_pairs(open_members, limit), "open-pairs")
    if not near.isEmpty():
        links = links.unionByName(stored(_confirmed(near, sets, percent), "near-links"))
        found = components(links)

    named = _with_components(classes.select("set_hash", "node", "n"), "node", "component", found)
    named = stored(named.select("set_hash", "component", "n"), "class-components")
    alone = F.coalesce("component", "doc_id")
    slim = signed.select("doc_id", "text_key", "n_shingles", "set_hash")
    done = lookup_groups(slim, named, ["set_hash"], "n", slim.count())
    return done.select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"),
        F.coalesce(F.col("doc_id") == alone, F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_duplicates`` keeps (known by doc_id and text)."""
    kept = _grouped(docs, percent).filter("kept").select(F.col("doc_id").alias("_keep"), F.col("text_key").alias("_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(kept["_keep"]) & (_text_key() == kept["_text"])
    return docs.join(kept, same, "left_semi")
