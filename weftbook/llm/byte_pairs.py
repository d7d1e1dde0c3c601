"""Byte-level BPE encoding and decoding by merge replay over the words of many texts at once.

Encoding a batch: texts are cut before every blank that a visible character follows (no match of the pattern crosses such a
place), segments that are new to the worker are split by the pattern, and the words found are joined to one byte string.  An
inverted index holds, for every pair of neighbouring tokens that the ranks can merge, the positions of the pair, under the rank
of what it becomes.  Merges are applied in rank order, each to all its positions; only the two neighbours of a merged pair
get new entries.  A word that is a token as it stands keeps that token.

Texts meet no other row: encoding and decoding are narrow passes over the table.  Memory of a worker is bounded in bytes: it holds
HELD_CHARS of texts (or one longer text), merges REPLAY_BYTES of their words at once and remembers KEPT_BYTES of segments, long
ones never.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftbook.llm.common import text_runs

HELD_CHARS = 12_000_000  # texts whose new words are merged together
REPLAY_BYTES = 2 << 20
KEPT_BYTES = 112 << 20
LONG = 64  # segments with more characters are not remembered
CHUNK_CHARS = 1_000_000
NONE = np.int64(1) << 62

# A blank before a visible character.  Python counts four more characters as white space than the pattern: the cut is safe.
CUT = re.compile(r" (?=\S)")
ODD_BLANK = re.compile(r" (?:\s|\Z)")

ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def segments(text: str) -> list[str]:
    """Parts of a text whose ids do not depend on one another, without the blank that starts each but the first."""
    return CUT.split(text) if ODD_BLANK.search(text) else text.split(" ")


class ByteVocabulary:
    """The ranks of a vocabulary file and the ids of segments met so far; without a pattern it can only decode."""

    def __init__(self, path: str, pattern: str = ""):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.forget()
        if not pattern:
            return
        import regex

        self.packed = np.arange(len(self.bytes_of), dtype="<u4").tobytes()

        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # Every way in which two tokens make a third, once by the left and once by the right one.
        ways = np.array(
            [
                (left, right, rank)
                for token, rank in self.ranks.items()
                for cut in range(1, len(token))
                if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
            ],
            np.int64,
        ).reshape(-1, 3)
        size = np.arange(len(self.bytes_of) + 1)
        self.sides = []
        for own, other in ((0, 1), (1, 0)):
            sorted_ways = ways[np.lexsort((ways[:, other], ways[:, own]))]
            starts = np.searchsorted(sorted_ways[:, own], size).tolist()
            self.sides.append((starts, sorted_ways[:, other].copy(), sorted_ways[:, 2].copy()))
        lowest = np.full(len(self.bytes_of), NONE)
        for own in (0, 1):
            np.minimum.at(lowest, ways[:, own], ways[:, 2])
        # Tokens that no merge of a smaller rank can take up: all their pairs in a word can be merged at once.
        self.settled = (lowest > size[:-1]).tolist()

    def forget(self) -> None:
        """Drop what was learnt: ids by segment, apart for those that start a text and for those after a blank, without it."""
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.kept = 0

    def _ranks_with(self, token: int, others: np.ndarray, right: int) -> np.ndarray:
        """Ranks of ``token`` joined with each of ``others``; ``right`` 1: ``token`` is the right one."""
        starts, partners, ranks = self.sides[right]
        partners, ranks = partners[starts[token] : starts[token + 1]], ranks[starts[token] : starts[token + 1]]
        if not len(partners):
            return np.full(len(others), NONE)
        where = np.minimum(np.searchsorted(partners, others), len(partners) - 1)
        return np.where(partners[where] == others, ranks[where], NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word (none empty), each as a little-endian unsigned 32-bit integer."""
        if not words:
            return []
        ends = np.cumsum([len(w) for w in words])
        n = int(ends[-1])
        # Place n stands for "none": its token joins with nothing.
        tokens = np.append(self.single[np.frombuffer(b"".join(words), np.uint8)], -1)
        owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        behind, before = np.arange(1, n + 2), np.arange(-1, n)
        behind[ends - 1] = behind[n] = n
        before[np.append(0, ends)] = n
        pair = np.full(n + 1, NONE)  # rank of the pair that starts at a place
        for byte in np.unique(tokens[:n]).tolist():
            places = np.flatnonzero(tokens == byte)
            pair[places] = self._ranks_with(byte, tokens[behind[places]], 0)
        index: dict[int, list[int]] = {}
        queue: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order].tolist()
            heads = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
            for rank, low, high in zip(ranks[heads].tolist(), heads, [*heads[1:], len(places)]):
                if rank in index:
                    index[rank] += places[low:high]
                else:
                    index[rank] = places[low:high]
                    heappush(queue, rank)

        usable = np.flatnonzero(pair < NONE)
        enter(pair[usable], usable)
        while queue:
            rank = heappop(queue)
            left = np.array(sorted(set(index.pop(rank))))
            left = left[pair[left] == rank]  # others have met another neighbour since
            if len(left) > 1:
                left, later = self._together(rank, left, owner, tokens, behind, before)
                if len(later):
                    index[rank] = later.tolist()
                    heappush(queue, rank)
            right = behind[left]
            after = behind[right]
            tokens[left], tokens[right] = rank, -1
            behind[left], before[after] = after, left
            pair[right] = NONE
            first = before[left]
            pair[left] = ahead = self._ranks_with(rank, tokens[after], 0)
            back = self._ranks_with(rank, tokens[first], 1)
            pair[first] = back
            pair[n] = NONE
            ranks, places = np.concatenate([ahead, back]), np.concatenate([left, first])
            usable = (ranks < NONE) & (places < n)
            if usable.any():
                enter(ranks[usable], places[usable])
        alive = tokens[:n] >= 0
        flat = tokens[:n][alive].astype("<u4").tobytes()
        cuts = (4 * np.cumsum(alive)[ends - 1]).tolist()
        return [flat[low:high] for low, high in zip([0, *cuts], cuts)]

    def _together(self, rank: int, left, owner, tokens, behind, before) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs at ``left`` are merged at once, and which have to wait for that.

        Of pairs that overlap every second one is merged.  Where a merge could open one of a smaller rank, which a word
        takes before its next pair of this rank, only the first pair of each word is merged.
        """
        same = owner[left[1:]] == owner[left[:-1]]
        if not same.any():
            return left, left[:0]
        if not self.settled[rank]:
            opened = [
                self._ranks_with(rank, tokens[behind[behind[left]]], 0),
                self._ranks_with(rank, tokens[before[left]], 1),
                self._ranks_with(rank, np.array([rank]), 0),
            ]
            if min(o.min() for o in opened) < rank:
                leads = np.append(True, ~same)
                return left[leads], left[~leads]
        chained = np.append(False, behind[left[:-1]] == left[1:])
        steps = np.arange(len(left))
        odd = (steps - np.maximum.accumulate(np.where(chained, 0, steps))) % 2 == 1
        return left[~odd], left[:0]

    def learn(self, new: list[str], follows: int) -> None:
        """Find the ids of new segments, all in one index; ``follows`` 1: a blank comes before each."""
        known, findall, kept = self.known[follows], self.pattern.findall, 0
        found = [findall(" " + s) for s in new] if follows else [findall(s) for s in new]
        words = list(set().union(*found))
        raw = [word.encode() for word in words]
        ranks = [self.ranks.get(r) for r in raw]
        merged = iter(self.replay([r for r, rank in zip(raw, ranks) if rank is None]))
        packed = self.packed
        ids = {
            word: next(merged) if rank is None else packed[4 * rank : 4 * rank + 4] for word, rank in zip(words, ranks)
        }
        for segment, parts in zip(new, found):
            value = known[segment] = ids[parts[0]] if len(parts) == 1 else b"".join([ids[w] for w in parts])
            kept += 200 + 2 * len(segment) + len(value)
        self.kept += kept

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        if self.kept > KEPT_BYTES:
            self.forget()
        heads, rest = self.known
        first, later, some, chars = set(), set(), [], 0
        for text in texts:
            parts = segments(text)
            first.add(parts.pop(0))
            some.append(parts)
            chars += len(text)
            if chars >= CHUNK_CHARS:
                later.update(set().union(*some).difference(rest))
                some, chars = [], 0
        later.update(set().union(*some).difference(rest))
        first.difference_update(heads)
        for follows, fresh in enumerate((first, later)):
            new, size = [], 0
            for segment in fresh:
                new.append(segment)
                size += len(segment)
                if size >= REPLAY_BYTES:
                    self.learn(new, follows)
                    new, size = [], 0
            self.learn(new, follows)
        out = []
        for text in texts:
            parts = segments(text)
            ids = [heads[parts[0]]]
            ids += [rest[p] for p in parts[1:]]
            out.append(b"".join(ids))
        for fresh, known in ((first, heads), (later, rest)):
            for segment in fresh:
                if len(segment) > LONG:
                    self.kept -= 200 + 2 * len(segment) + len(known.pop(segment))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; ids that the vocabulary does not have stand for nothing."""
        numbers = np.frombuffer(ids, "<u4")
        if numbers.max(initial=0) >= len(self.bytes_of):
            numbers = numbers[numbers < len(self.bytes_of)]
        return b"".join(map(self.bytes_of.__getitem__, numbers.tolist()))


_loaded: dict[tuple[str, str], ByteVocabulary] = {}


def vocabulary(path: str, pattern: str) -> ByteVocabulary:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteVocabulary(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids (unsigned 32-bit little-endian) of every row of ``docs`` (doc_id, text; others are ignored).

    ``ranks``: path of a rank file that all executors have; ``pattern``: what splits texts into words.  Strings of special
    tokens are ordinary text.  Null and empty texts have no ids; repeated rows and null doc_ids are rows like any other; texts
    of any length are encoded whole; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks, pattern)
        for ids, texts in text_runs(batches, HELD_CHARS):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words.encode(texts), pa.binary())], schema=ENCODED
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(work, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for, column ``decoded``; null ids give no bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks, "")
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                raw = [words.decode(ids or b"") for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], schema=DECODED)

    rows = encoded.select(F.col("doc_id").cast("long"), "ids")
    return rows.mapInArrow(work, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex of the ids' and the texts' bytes).

    ``encode`` and then ``decode``, in one pass of one worker: ids do not leave it before they are decoded.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks, pattern)
        for ids, texts in text_runs(batches, HELD_CHARS):
            encoded = words.encode(texts)
            del texts
            for at in range(0, len(ids), 200):
                part = encoded[at : at + 200]
                columns = [pa.array(ids[at : at + 200], pa.int64()), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(map(words.decode, part), pa.binary())], schema=DECODED)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(work, "doc_id long, ids binary, decoded binary").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
