"""Harmonic packing of tokenised documents into sequences.

A document of n ids belongs to class k = capacity // n: k documents of that class always fit one bin.  Every worker
keeps one open bin per class and closes it at exactly k documents, without looking at other workers.  What a closed
bin lacks is filled by slices of documents longer than the capacity (they must be cut anyway), and, if too many bins
wait, of the next document at hand.  What is open at the end of a worker's input is cut into full sequences, and
the last tail into sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled and a worker holds at most one bin per class and WAITING gapped bins.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftbook.llm.common import small_batches, text_runs

WAITING = 64
KEPT_BYTES = 112 << 20
LONG = 64  # words with more bytes are not remembered
LEARN_WORDS = 50_000
CHUNK_CHARS = 2_000_000
SEQUENCE_BITS = 40

# Words made of these characters only are lower-cased and split here: all of them are their own composed form, none is
# white space.  The split is that of the vocabulary's own pre-tokeniser (fixed values), limited to these characters.
PLAIN = re.compile("[\x21-\x7e\xa1-\xff]+")
PRE_TOKENS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-z0-9ªµºß-öø-ÿ²³¹¼½¾]+"
)

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


class WordTokenizer:
    """The vocabulary's ids of whole texts, computed once per distinct white-space separated word.

    The pre-tokeniser never joins characters across white space, so a text's ids are those of its words in turn.  Words used
    lately are remembered in two generations of KEPT_BYTES each; long words are not.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.end = np.array([end_id], "<u4").tobytes()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.kept = 0

    def _remember(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.kept += 170 + len(word) + len(ids)

    def _learn(self, words: list[bytes]) -> None:
        """Add the ids of new words."""
        texts = [w.decode() for w in words]
        plain = [PRE_TOKENS.findall(t.lower()) if PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        new = list({p for parts in plain if parts for p in parts})
        pieces = {p: e.ids for p, e in zip(new, self.bare.encode_batch_fast(new, add_special_tokens=False))}
        other = [t for t, parts in zip(texts, plain) if parts is None]
        rest = iter(self.whole.encode_batch_fast(other, add_special_tokens=False))
        ids: list[int] = []
        ends = []
        for parts in plain:
            if parts is None:
                ids += next(rest).ids
            else:
                for piece in parts:
                    ids += pieces[piece]
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        for word, start, end in zip(words, [0, *ends], ends):
            self._remember(word, raw[start:end])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, closed by the end id."""
        if self.kept > KEPT_BYTES:
            self.known, self.older, self.kept = {}, self.known, 0
        split = [t.encode().split() for t in texts]
        fresh = set().union(*split).difference(self.known)
        new = []
        for word in fresh:
            ids = self.older.get(word)
            if ids is None:
                new.append(word)
            else:
                self._remember(word, ids)
        for at in range(0, len(new), LEARN_WORDS):
            self._learn(new[at : at + LEARN_WORDS])
        known = self.known
        out = [np.frombuffer(b"".join([known[w] for w in words]) + self.end, "<u4") for words in split]
        for word in fresh:
            if len(word) > LONG:
                self.kept -= 170 + len(word) + len(known.pop(word))
        return out


_loaded: dict[tuple[str, int], WordTokenizer] = {}


def _tokenizer(path: str, end_id: int) -> WordTokenizer:
    if (path, end_id) not in _loaded:
        _loaded[path, end_id] = WordTokenizer(path, end_id)
    return _loaded[path, end_id]


class HarmonicPacker:
    """One worker's bins.  A piece is (doc, start, ids, ids of the document); closed sequences go to ``rows``."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.next_id = capacity, worker << SEQUENCE_BITS
        self.open: dict[int, list] = {}
        self.waiting: list[tuple[list, int]] = []  # pieces of a closed bin, ids that it lacks
        self.rows: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def _fill(self, doc, ids: np.ndarray, total: int) -> int:
        """Cut a document from its start into the gaps of waiting bins; where its rest starts."""
        start = 0
        while self.waiting and start < len(ids):
            pieces, gap = self.waiting.pop()
            pieces.append((doc, start, ids[start : start + gap], total))
            taken = len(pieces[-1][2])
            start += taken
            if taken < gap:
                self.waiting.append((pieces, gap - taken))
            else:
                self._close(pieces)
        return start

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        if total > self.capacity or len(self.waiting) >= WAITING:
            start = self._fill(doc, ids, total)
        while total - start >= self.capacity:
            self._close([(doc, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        if start == total:
            return
        kind = self.capacity // (total - start)
        pieces = self.open.setdefault(kind, [])
        pieces.append((doc, start, ids[start:], total))
        if len(pieces) == kind:
            del self.open[kind]
            gap = self.capacity - sum(len(p[2]) for p in pieces)
            if gap:
                self.waiting.append((pieces, gap))
            else:
                self._close(pieces)

    def finish(self) -> None:
        """Cut all that is not closed into full sequences and a tail of powers of two."""
        pool = [p for pieces, _ in self.waiting for p in pieces] + [p for k in sorted(self.open) for p in self.open[k]]
        self.waiting, self.open = [], {}
        left = sum(len(p[2]) for p in pool)
        sizes = [self.capacity] * (left // self.capacity)
        left %= self.capacity
        sizes += [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        pieces, room = [], sizes.pop(0) if sizes else 0
        for doc, start, ids, total in pool:
            while len(ids):
                pieces.append((doc, start, ids[:room], total))
                taken = len(pieces[-1][2])
                start, ids, room = start + taken, ids[taken:], room - taken
                if not room:
                    self._close(pieces)
                    pieces, room = [], sizes.pop(0) if sizes else 0

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        while len(self.rows) >= max(least, 1):
            part, self.rows = self.rows[:4000], self.rows[4000:]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), ARROW)], schema=ARROW)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` ids.

    ``docs``: doc_id and text, other columns are ignored.  ``tokenizer``: path of a vocabulary file that every
    executor has.  Returns per piece doc_id, start, length, ids (unsigned 32-bit little-endian), doc_tokens,
    sequence_id and offset.  A null or empty text is a document of the end id alone; repeated rows and null doc_ids are
    packed like any other; an empty table gives no rows.  Sequence ids hold the number of the partition, so the
    input should be a stored table: its partitions then come back alike when an executor is lost.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _tokenizer(tokenizer, end_id)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId())
        for ids, texts in text_runs(batches, CHUNK_CHARS):
            for doc, tokens in zip(ids, words.encode(texts)):
                packer.add(doc, tokens)
            yield from packer.take(4000)
        packer.finish()
        yield from packer.take(1)

    texts = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(work, SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC-32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
