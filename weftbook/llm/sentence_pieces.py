"""SentencePiece encoding and decoding; pieces are found in whole batches by suffix arrays.

Encoding a batch: texts are cut where a blank follows a character (no piece crosses such a place), and segments that are new
to the worker are joined to one text.  Its suffixes are sorted by as many characters as the longest piece has, every
piece is binary-searched for its range of occurrences, and the occurrences, sorted by position, are the edges.  The
vocabularies here are byte-pair ones, whose ids are defined by merges and not by a cheapest path; so the edges are relaxed in
merge order: of all edges that join two neighbouring parts, each segment takes the one with the best score, then the
leftmost, until none is left.  Characters without a piece become byte pieces.

Texts meet no other row: encoding and decoding are narrow passes over the table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftbook.llm.common import small_batches

BLANK = "▁"
SEGMENT = re.compile(" +[^ ]*")
SEGMENTS_KEPT = 400_000
INDEX_CHARS = 600_000
CHUNK_CHARS = 3_000_000
PACKED = 62  # bits of a number that several codes share
LONG = 48  # segments with more characters are merged with a queue of their own
NONE = np.int64(1) << 62

ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def numbered(codes: np.ndarray) -> np.ndarray:
    """The numbers of the codes that occur, from 1 and in their order, by code; 0 for the others."""
    met = np.zeros(int(codes.max()) + 1, bool)
    met[codes] = True
    return np.where(met, np.cumsum(met), 0)


def packed(numbers: np.ndarray, bits: int, width: int) -> np.ndarray:
    """At every place the next ``width`` numbers as one; behind the end all are 0."""
    n = len(numbers)
    padded = np.concatenate([numbers, np.zeros(width, np.int64)])
    key = padded[:n]
    for k in range(1, width):
        key = (key << bits) | padded[k : n + k]
    return key


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` or more codes."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    number = numbered(codes)
    bits = int(number.max()).bit_length()
    width = max(min(PACKED // bits, depth), 1)  # so many codes are sorted at once
    key = packed(number[codes], bits, width)
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        behind = np.zeros(n, np.int64)
        behind[:-width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + behind
        width *= 2


class Vocabulary:
    """The pieces of a model file and the ids of segments met so far."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = model.unk_id()
        self.byte_ids: dict[int, int] = {}
        self.bytes_of: list[bytes] = []
        self.normal: dict[str, int] = {}
        self.score: list[float] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.score.append(model.get_score(i))
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i):
                self.bytes_of.append(b"")
            elif model.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.normal[piece] = i
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
        # Rank of every piece by score; equal scores are equal ranks.
        levels = {s: r for r, s in enumerate(sorted({-s for s in self.score}))}
        self.rank = np.array([levels[-s] for s in self.score], np.int64)
        joined = sorted((p, i) for p, i in self.normal.items() if len(p) > 1)
        self.longest = max((len(p) for p, _ in joined), default=1)
        self.piece_ids = np.array([i for _, i in joined], np.int64)
        self.piece_sizes = np.array([len(p) for p, _ in joined], np.int64)
        self.piece_codes = np.zeros((len(joined), self.longest), np.int64)
        for row, (p, _) in enumerate(joined):
            self.piece_codes[row, : len(p)] = [ord(c) for c in p]
        self.known: dict[str, bytes] = {}  # ids of a segment, 4 bytes each

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of pieces of two or more characters: start, length and id, sorted by start, then length."""
        if not len(codes) or not len(self.piece_ids):
            return (np.empty(0, np.int64),) * 3
        order = suffix_array(codes, self.longest)
        padded = np.concatenate([codes, np.full(self.longest, -1, np.int64)])
        # The first codes of all suffixes and pieces as one number each: the range of a short piece, and where longer ones can be.
        number = numbered(codes)
        bits = int(number.max()).bit_length()
        width = min(PACKED // bits, self.longest)
        keys = packed(number[codes], bits, width)[order]
        sizes = self.piece_sizes
        theirs = np.where(self.piece_codes < len(number), number[np.minimum(self.piece_codes, len(number) - 1)], 0)
        inside = np.arange(self.longest) < sizes[:, None]
        low, high = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k in range(width):
            low = (low << bits) | np.where(inside[:, k], theirs[:, k], 0)
            high = (high << bits) | np.where(inside[:, k], theirs[:, k], (1 << bits) - 1)
        low, high = np.searchsorted(keys, low), np.searchsorted(keys, high, side="right")
        high = np.where((inside & (theirs == 0)).any(axis=1), low, high)

        def border(after: bool) -> np.ndarray:
            """First place in the order whose suffix is not before (or not before and not starting with) each piece."""
            left, right = np.where(after & (sizes <= width), high, low), np.where(sizes > width, high, 0)
            while (live := np.nonzero(left < right)[0]).size:
                middle = (left[live] + right[live]) // 2
                start = order[middle]
                less = np.zeros(live.size, bool)
                equal = np.ones(live.size, bool)
                for i in range(width, self.longest):
                    ask = np.nonzero(equal & (i < sizes[live]))[0]
                    if not ask.size:
                        break
                    mine, piece = padded[start[ask] + i], self.piece_codes[live[ask], i]
                    less[ask] = mine < piece
                    equal[ask] = mine == piece
                before = (less & ~equal) | (equal if after else False)
                left[live] = np.where(before, middle + 1, left[live])
                right[live] = np.where(before, right[live], middle)
            return left

        first, last = border(False), border(True)
        counts = last - first
        places = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        starts = order[places]
        rows = np.repeat(np.arange(len(counts)), counts)
        by_place = np.argsort(starts * (self.longest + 1) + self.piece_sizes[rows])
        return starts[by_place], self.piece_sizes[rows][by_place], self.piece_ids[rows][by_place]

    def _finish(self, text: str) -> list[int]:
        """Ids of one character: its piece, or the bytes of one without."""
        found = self.normal.get(text)
        if found is not None:
            return [found]
        if self.byte_ids:
            return [self.byte_ids[b] for b in text.encode()]
        return [self.unknown]

    def _relax_long(self, start: int, end: int, table: np.ndarray) -> list[tuple[int, int]]:
        """Parts of one long segment: joins in order of score and place, from a queue."""
        behind = list(range(1, end - start + 1))
        before = list(range(-1, end - start - 1))
        alive = [True] * (end - start)
        queue: list[tuple[int, int, int]] = []

        def offer(left: int) -> None:
            middle = behind[left]
            if middle < end - start:
                size = behind[middle] - left
                if size <= self.longest and (piece := table[start + left, size]) >= 0:
                    heapq.heappush(queue, (int(self.rank[piece]), left, size))

        for left in range(end - start - 1):
            offer(left)
        while queue:
            _, left, size = heapq.heappop(queue)
            middle = behind[left] if alive[left] else end - start
            if middle >= end - start or behind[middle] - left != size:
                continue
            alive[middle] = False
            behind[left] = behind[middle]
            if behind[left] < end - start:
                before[behind[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [(start + i, start + behind[i]) for i in range(end - start) if alive[i]]

    def _relax(self, begins: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the parts of many short segments; in each round every segment takes its best edge."""
        sizes = ends - begins
        starts = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        stops = starts + 1
        owner = np.repeat(np.arange(len(begins)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(starts):
            width = np.concatenate([stops[1:] - starts[:-1], [0]])
            usable = np.concatenate([owner[1:] == owner[:-1], [False]]) & (width <= self.longest)
            piece = np.where(usable, table[starts, np.where(usable, width, 0)], -1)
            key = np.where(piece >= 0, (self.rank[piece] << 32) | np.arange(len(starts)), NONE)
            heads = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
            best = np.minimum.reduceat(key, heads)
            live = best < NONE
            at = best[live] & 0xFFFFFFFF
            stops[at] = stops[at + 1]
            keep = np.ones(len(starts), bool)
            keep[at + 1] = False
            over = ~np.repeat(live, np.diff(np.append(heads, len(starts))))
            done.append((starts[over], stops[over]))
            keep &= ~over
            starts, stops, owner = starts[keep], stops[keep], owner[keep]
        if not done:
            return starts, stops
        starts, stops = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(starts)
        return starts[order], stops[order]

    def learn(self, segments: list[str]) -> None:
        """Find the ids of new segments, all in one index."""
        joined = "".join(segments).replace(" ", BLANK)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(s) for s in segments], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        where, length, piece = self.edges(codes)
        table = np.full((len(codes), self.longest + 1), -1, np.int32)
        inside = where + length <= ends[np.searchsorted(ends, where, side="right")] if len(where) else np.array([], bool)
        table[where[inside], length[inside]] = piece[inside]
        short = sizes <= LONG
        starts, stops = self._relax(begins[short], ends[short], table)
        parts = [(starts, stops)]
        for b, e in zip(begins[~short], ends[~short]):
            long = self._relax_long(int(b), int(e), table)
            parts.append((np.array([p[0] for p in long]), np.array([p[1] for p in long])))
        starts, stops = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
        order = np.argsort(starts)
        starts, stops = starts[order], stops[order]
        width = stops - starts
        single = width == 1
        pieces = table[starts, width]
        # The ids of a single character: its piece, or its bytes.
        characters, which = np.unique(codes[starts[single]], return_inverse=True)
        found = [self._finish(chr(c)) for c in characters.tolist()]
        own = np.zeros((len(found), max(map(len, found), default=1)), np.uint32)
        many = np.array([len(f) for f in found], np.int64)
        for row, f in enumerate(found):
            own[row, : len(f)] = f
        counts = np.ones(len(starts), np.int64)
        counts[single] = many[which]
        behind = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(behind[-1], np.uint32)
        flat[behind[:-1][~single]] = pieces[~single]
        places = behind[:-1][single]
        for i in range(own.shape[1]):
            longer = many[which] > i
            flat[places[longer] + i] = own[which[longer], i]
        borders = (4 * behind[np.searchsorted(starts, np.append(begins, len(codes)))]).tolist()
        raw = flat.astype("<u4").tobytes()
        self.known.update(zip(segments, (raw[a:b] for a, b in pairwise(borders))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > SEGMENTS_KEPT:
            self.known.clear()
        cut = [segments(t) for t in texts]
        new, size = [], 0
        for segment in [s for s in dict.fromkeys(chain.from_iterable(cut)) if s not in self.known]:
            new.append(segment)
            size += len(segment)
            if size > INDEX_CHARS:
                self.learn(new)
                new, size = [], 0
        if new:
            self.learn(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4") for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; byte pieces that are no UTF-8 come out as U+FFFD.  The blank set before every text goes again."""
        size = len(self.bytes_of)
        raw = b"".join(self.bytes_of[i] if i < size else b"" for i in ids.tolist())
        return raw.decode("utf-8", "replace").removeprefix(" ")


def segments(text: str) -> list[str]:
    """Runs of blanks with the characters behind them; a text starts with one blank more."""
    return SEGMENT.findall(" " + text.replace(BLANK, " ")) if text else []


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (unsigned 32-bit little-endian) of every row of ``docs`` (doc_id, text; others are ignored).

    ``model``: path of a SentencePiece file that all executors have.  Null and empty texts have no ids; repeated rows and null
    doc_ids are rows like any other; texts of any length are encoded whole; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            docs_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            first, chars = 0, 0
            for i, text in enumerate(texts):
                chars += len(text or "")
                if chars >= CHUNK_CHARS or i == len(texts) - 1:
                    found = words.encode([t or "" for t in texts[first : i + 1]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs_of[first : i + 1], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())],
                        schema=ENCODED,
                    )
                    first, chars = i + 1, 0

    texts = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(work, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text that the ids stand for, column ``decoded``; null ids give an empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                texts = [words.decode(np.frombuffer(raw or b"", np.uint32)) for raw in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], schema=DECODED)

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(
        work, "doc_id long, ids binary, decoded string"
    )


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode: doc_id, n_ids, ids_crc32, decoded_chars, decoded_crc32."""
    both = decode(encode(docs, model), model)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.char_length("decoded").cast("long").alias("decoded_chars"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )
