"""Alignment of two tokenizers and corpus counts of their linked ids, by inverted pair bitmaps.

A text is encoded twice; tokens of both sides whose byte ranges overlap are linked.  Both tokenizers work word by word, so texts
are cut where neither can join across (a single blank between visible characters), and each distinct segment is
encoded and aligned once per worker.

The inverted index: documents are numbered in containers of up to SLOTS.  For each container and each pair of ids that is linked
in it, one row holds bitmaps over the container's slots: plane k has the documents whose number of such links has bit k set.
A bitmap is a sorted list of slots or, where that is shorter, a bit field.  OR-merged, the planes are the pair's document bitmap,
whose population count is the number of documents; the planes' population counts, shifted by k, add up to the number of links.
Sums over the containers are the corpus counts.  Going back, each posting adds its pair's count to the slots of its planes, one
container per task group.

A container ends at SLOTS documents or about ENTRIES postings, so every group has a bounded size however large the corpus is, but for a single long
document, whose postings are its distinct pairs.  A pair has one row per container, so no pair can hold a large share of the rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftbook.llm.common import stored, text_runs

SLOTS = 4096
ENTRIES = 400_000
CHUNK_CHARS = 1_000_000
LEARN_CHARS = 250_000
KEPT_BYTES = 96 << 20
LONG = 64  # segments with more characters are not remembered
BLANK = "▁"
CONTAINER_BITS = 32
A_SHIFT, B_SHIFT = 40, 16  # a pair and a slot in one number: a, b, slot
FIELD = SLOTS // 16  # 16-bit words of a bit field
DENSE = 0xFFFF

# A single blank between characters that are no white space: no token of either side goes across it.
CUT = re.compile(r"(?<! ) (?=\S)")
ODD_BLANK = re.compile(r" (?:\s|\Z)")

INDEX = pa.schema(
    [("container", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
     ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.binary()), ("pair", pa.int64()),
     ("documents", pa.int64()), ("links", pa.int64()), ("planes", pa.binary())]
)
SCHEMA = (
    "container long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups binary, "
    "pair long, documents long, links long, planes binary"
)
SCORES = pa.schema([("container", pa.int64()), ("slot", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def unescaped(symbol: str) -> bytes:
    """Bytes of an entry of a byte-level vocabulary (the usual printable stand-ins for bytes)."""
    return bytes(_BYTE_OF[c] for c in symbol) if all(c in _BYTE_OF for c in symbol) else symbol.encode()


def _stand_ins() -> dict[str, int]:
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


_BYTE_OF = _stand_ins()


class Aligner:
    """Two vocabularies, and the alignments of the segments met so far, numbered."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_size, b_size = self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [unescaped(self.a.id_to_token(i) or "") for i in range(a_size)]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode()
            for i, p in enumerate(self.b.id_to_piece(i) for i in range(b_size))
        ]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        # Texts of all ids with the mark that follows: inside a side, behind it.
        self.marked = [f"{i}{mark}".encode() for size, marks in ((a_size, ",|"), (b_size, ",;")) for mark in marks for i in range(size)]
        self.offsets = np.cumsum([0, a_size, a_size, b_size])
        inner = re.compile(f"[^{BLANK}]{BLANK}")
        if any(inner.search(self.b.id_to_piece(i)) for i in range(b_size)):
            raise ValueError("the piece model joins words")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pairs: list[bytes] = []
        self.groups: list[bytes | None] = []
        self.counts = np.empty((1024, 3), np.int64)
        self.long: list[str] = []
        self.kept = 0

    def learn(self, new: list[str]) -> None:
        """Encode and align new segments (each starts with a blank)."""
        if not new:
            return
        first = len(self.pairs)
        raw = [s.encode() for s in new]
        a_ids = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        b_ids = self.b.encode([s[1:] for s in new], num_threads=1)
        good = [
            b"".join([self.a_bytes[i] for i in a]) == r and b"".join([self.b_bytes[i] for i in b]) == r
            for r, a, b in zip(raw, a_ids, b_ids)
        ]
        a_ids = [a if g else [] for a, g in zip(a_ids, good)]
        b_ids = [b if g else [] for b, g in zip(b_ids, good)]
        counts = np.array([(len(a), len(b), 0) for a, b in zip(a_ids, b_ids)], np.int64)
        a = np.array([i for ids in a_ids for i in ids], np.int64)
        b = np.array([i for ids in b_ids for i in ids], np.int64)
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        common = a_end[np.isin(a_end, b_end, assume_unique=True)]
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        a_segment = np.repeat(np.arange(len(new)), counts[:, 0])
        # The last token of a group ends where the group does; each group is of one segment.
        a_last, b_last = common[a_group] == a_end, common[b_group] == b_end
        counts[:, 2] = np.bincount(a_segment[a_last], minlength=len(new))
        low = np.searchsorted(b_end, a_end - self.a_sizes[a], side="right")
        many = np.searchsorted(b_end - self.b_sizes[b], a_end, side="left") - low
        linked = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        pairs = (np.repeat(a, many) << A_SHIFT | b[linked] << B_SHIFT).astype("<i8").tobytes()
        ends = np.cumsum(np.bincount(a_segment, weights=many, minlength=len(new)).astype(np.int64)) * 8
        codes = np.concatenate([a + self.offsets[a_last.astype(int)], b + self.offsets[2 + b_last.astype(int)]])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        texts = list(map(self.marked.__getitem__, codes[order].tolist()))
        text_ends = np.cumsum(counts[:, 0] + counts[:, 1])
        start = text_start = 0
        for i, (segment, end, text_end, fits) in enumerate(zip(new, ends.tolist(), text_ends.tolist(), good)):
            self.known[segment] = first + i
            self.pairs.append(pairs[start:end])
            self.groups.append(b"".join(texts[text_start:text_end])[:-1] if fits else None)
            start, text_start = end, text_end
        while len(self.counts) < len(self.pairs):
            self.counts = np.concatenate([self.counts, self.counts])
        self.counts[first : len(self.pairs)] = counts
        self.long += [s for s in new if len(s) > LONG]
        self.kept += 350 * len(new) + 2 * sum(map(len, raw)) + len(pairs) + sum(map(len, texts))

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The segments of every text by number; texts without tokens have none."""
        if self.kept > KEPT_BYTES:
            self.forget()
        cut = []
        for text in texts:
            whole = " " + text if text else ""
            first, *rest = CUT.split(whole) if ODD_BLANK.search(whole) else whole.split(" ")
            cut.append([first] * bool(first) + [" " + p for p in rest])
        new, size = [], 0
        for segment in set().union(*cut).difference(self.known):
            new.append(segment)
            size += len(segment)
            if size >= LEARN_CHARS:
                self.learn(new)
                new, size = [], 0
        self.learn(new)
        known, groups = self.known, self.groups
        found = [[known[s] for s in parts] for parts in cut]
        return [[] if any(groups[n] is None for n in set(numbers)) else numbers for numbers in found]

    def release(self) -> None:
        """Stop remembering long segments; their numbers stay unused."""
        for segment in self.long:
            number = self.known.pop(segment)
            self.kept -= 2 * len(segment) + len(self.pairs[number]) + len(self.groups[number] or b"")
            self.pairs[number], self.groups[number] = b"", b""
        self.long = []


def encode_planes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Postings of one container: pairs, documents and links of each, and the planes of each as bytes.

    ``keys``: sorted numbers made of pair and slot, no two alike; ``counts``: links of each.  Planes are 16-bit words: number of the
    plane, number of slots, slots; or number, DENSE, bit field.
    """
    pair, slot = keys >> B_SHIFT, keys & 0xFFFF
    heads = np.flatnonzero(np.diff(pair, prepend=-1))
    row = np.cumsum(np.diff(pair, prepend=-1) != 0) - 1
    planes = [np.flatnonzero(counts >> k & 1) for k in range(int(counts.max()).bit_length())]
    entry = np.concatenate(planes)
    plane = np.repeat(np.arange(len(planes)), [len(p) for p in planes])
    order = np.lexsort((plane, row[entry]))  # stable: slots stay in order
    entry, plane = entry[order], plane[order]
    group = row[entry] * 64 + plane
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(starts, len(group)))
    dense = sizes > FIELD
    words = 2 + np.where(dense, FIELD, sizes)
    at = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), "<u2")
    out[at] = plane[starts]
    out[at + 1] = np.where(dense, DENSE, sizes)
    sparse = np.repeat(~dense, sizes)
    places = np.repeat(at + 2 - starts, sizes) + np.arange(len(group))
    out[places[sparse]] = slot[entry[sparse]]
    for g in np.flatnonzero(dense).tolist():
        bits = np.zeros(SLOTS, np.uint8)
        bits[slot[entry[starts[g] : starts[g] + sizes[g]]]] = 1
        out[at[g] + 2 : at[g] + 2 + FIELD] = np.packbits(bits, bitorder="little").view("<u2")
    documents = np.diff(np.append(heads, len(pair)))  # population count of the OR of the planes
    links = np.add.reduceat(sizes << plane[starts], np.flatnonzero(np.diff(row[entry[starts]], prepend=-1)))
    ends = np.add.reduceat(words, np.flatnonzero(np.diff(row[entry[starts]], prepend=-1))).cumsum() * 2
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
    return pair[heads], documents, links, blobs


def decode_planes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of postings: row, slot and weight (2 to the power of the plane)."""
    words = np.frombuffer(b"".join(blobs), "<u2").astype(np.int64)
    ends = np.cumsum([len(b) // 2 for b in blobs])
    rows, slots, weights = [], [], []
    at, row = np.concatenate([[0], ends[:-1]]).astype(np.int64), np.arange(len(blobs))
    while len(at):  # the next plane of every row that has one more
        sizes, plane = words[at + 1], words[at]
        dense = sizes == DENSE
        sparse = np.flatnonzero(~dense)
        many = sizes[sparse]
        places = np.repeat(at[sparse] + 2 - np.cumsum(many) + many, many) + np.arange(many.sum())
        rows.append(np.repeat(row[sparse], many))
        slots.append(words[places])
        weights.append(np.repeat(np.int64(1) << plane[sparse], many))
        for i in np.flatnonzero(dense).tolist():
            field = words[at[i] + 2 : at[i] + 2 + FIELD].astype("<u2").view(np.uint8)
            held = np.flatnonzero(np.unpackbits(field, bitorder="little"))
            rows.append(np.full(len(held), row[i]))
            slots.append(held)
            weights.append(np.full(len(held), np.int64(1) << plane[i]))
        at = at + 2 + np.where(dense, FIELD, sizes)
        more = at < ends[row]
        at, row = at[more], row[more]
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, slots, weights))


class _Container:
    """Postings of the documents of one container, as sorted keys with counts."""

    def __init__(self, number: int):
        self.number, self.slot = number, 0
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.entries = 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.entries += len(keys)

    def postings(self) -> Iterator[pa.RecordBatch]:
        if not self.entries:
            return
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.diff(keys, prepend=-1))  # parts of one document meet here
        pair, documents, links, blobs = encode_planes(keys[heads], np.add.reduceat(counts, heads))
        columns = {
            "container": pa.array(np.full(len(pair), self.number), pa.int64()), "pair": pa.array(pair, pa.int64()),
            "documents": pa.array(documents, pa.int64()), "links": pa.array(links, pa.int64()), "planes": blobs,
        }
        yield _record(columns, len(pair))


def _record(columns: dict[str, pa.Array], size: int) -> pa.RecordBatch:
    """A batch of the index schema; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in INDEX], schema=INDEX)


_loaded: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _loaded:
        _loaded[a, b] = Aligner(a, b)
    return _loaded[a, b]


def build_index(
    docs: DataFrame, byte_vocabulary: str, piece_model: str, slots: int = SLOTS, entries: int = ENTRIES, keep_groups: bool = True
) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text; others are ignored); see ``alignments`` and ``postings`` for its two parts.

    ``byte_vocabulary`` and ``piece_model``: paths of the two vocabularies, which all executors have; ``slots`` (at most SLOTS) and
    ``entries``: documents and postings that close a container; ``keep_groups``: whether the groups' texts are stored beside their digests.  Texts that are null or empty, or
    whose tokens on either side are not the bytes of a blank and the text, have no tokens.  Repeated rows and null doc_ids are
    documents like any other; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(byte_vocabulary, piece_model)
        container = _Container(TaskContext.get().partitionId() << CONTAINER_BITS)
        for ids, texts in text_runs(batches, CHUNK_CHARS):
            rows: list[tuple] = []
            held, weight = [], 0
            for doc, numbers in zip(ids, aligner.numbers(texts)):
                slot = container.slot
                container.slot += 1
                counts, n_links = np.zeros(3, np.int64), 0
                for at in range(0, len(numbers), 100_000):
                    part = numbers[at : at + 100_000]
                    keys = np.frombuffer(b"".join([aligner.pairs[n] for n in part]), "<i8") | slot
                    counts += aligner.counts[part].sum(0)
                    n_links += len(keys)
                    weight += len(keys)
                    held.append(keys)
                    if weight >= entries:
                        container.add(np.concatenate(held))
                        held, weight = [], 0
                groups = b";".join([aligner.groups[n] for n in numbers])
                digest = hashlib.sha256(groups).hexdigest() if n_links else ""
                rows.append((container.number, slot, doc, *counts.tolist(), n_links, digest, groups if keep_groups else None))
                if container.slot == slots or container.entries >= entries:
                    if held:
                        container.add(np.concatenate(held))
                        held, weight = [], 0
                    yield from container.postings()
                    container = _Container(container.number + 1)
            if held:
                container.add(np.concatenate(held))
            aligner.release()
            names = INDEX.names[:9]
            columns = {n: pa.array(c, INDEX.field(n).type) for n, c in zip(names, zip(*rows))}
            yield _record(columns, len(rows))
        yield from container.postings()

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(texts.mapInArrow(work, SCHEMA), "pair-bitmaps")


def alignments(index: DataFrame) -> DataFrame:
    """Per document container, slot, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 ('' without tokens) and groups.

    ``groups``: ids of both sides between byte offsets where tokens of both end, as ``a1,a2|b1;a3|b2,b3``; empty without tokens.
    """
    return index.filter("slot is not null").select(
        "container", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.col("groups").cast("string")
    )


def postings(index: DataFrame) -> DataFrame:
    """Per container and linked pair of ids: container, pair, documents, links and planes."""
    return index.filter("pair is not null").select("container", "pair", "documents", "links", "planes")


def pair_counts(index: DataFrame) -> DataFrame:
    """Per linked pair of ids: pair, a, b, documents and links of the whole corpus, and whether b has no pair with more links."""
    counted = postings(index).groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    bits = A_SHIFT - B_SHIFT
    counted = stored(
        counted.select(
            "pair",
            F.shiftright("pair", bits).cast("int").alias("a"),
            F.col("pair").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("b"),
            "documents",
            "links",
        ),
        "pair-counts",
    )
    most = counted.groupBy("b").agg(F.max("links").alias("_most"))  # at most one row for each id of the piece model
    best = (F.col("links") == F.col("_most")).alias("best")
    return counted.join(F.broadcast(most), "b").select("pair", "a", "b", "documents", "links", best)


def document_scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document with links: container, slot, n_best (links of pairs that are best for their b) and count_sum."""

    def work(group: pa.Table) -> pa.Table:
        rows, slots, weights = decode_planes(group.column("planes").to_pylist())
        links = group.column("total").to_numpy()
        best = group.column("best").to_numpy().astype(np.int64)
        sums = np.zeros((SLOTS, 2), np.int64)
        np.add.at(sums[:, 0], slots, weights * best[rows])
        np.add.at(sums[:, 1], slots, weights * links[rows])
        held = np.unique(slots)
        number = group.column("container")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array(np.full(len(held), number), pa.int64()), pa.array(held, pa.int32()), pa.array(sums[held, 0]), pa.array(sums[held, 1])],
            schema=SCORES,
        )

    totals = counts.select("pair", F.col("links").alias("total"), "best")
    returned = postings(index).select("container", "pair", "planes").join(totals, "pair").drop("pair")
    return returned.groupBy("container").applyInArrow(work, "container long, slot int, n_best long, count_sum long")


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """Alignments of all documents with n_best and count_sum, 0 without links; edge cases as in ``build_index``."""
    index = build_index(docs, byte_vocabulary, piece_model)
    return with_scores(alignments(index), index)


def with_scores(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` (container and slot) with n_best and count_sum of each document."""
    scores = document_scores(index, pair_counts(index))
    return rows.join(scores, ["container", "slot"], "left").fillna(0, ["n_best", "count_sum"])


def alignment_digests(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """The numbers of ``align`` per document, with the SHA-256 of the groups in their place ('' without tokens)."""
    index = build_index(docs, byte_vocabulary, piece_model, keep_groups=False)
    return with_scores(alignments(index).drop("groups"), index).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
