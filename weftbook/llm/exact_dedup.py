"""Exact deduplication by Patricia tries: equal texts meet in one partition, and one terminal node owns them.

Texts are compared after deleting white space.  Every map task first inserts its own texts into a trie, so that a
group of copies, however large, leaves it as one row.  Those rows are partitioned by length and content hash and the full
byte strings inserted into tries whose terminal nodes hold the best row and the number of rows.  A trie has a byte
budget; beyond it its largest subtree is spilled: cut off, and its strings, with all later ones that would enter
it, handed on to a further round with other partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftbook.llm.common import lookup_groups, small_batches, stored, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
NODE_BYTES = 500  # what Python holds for a node beside its label
BUDGET_BYTES = 128 << 20
NO_ID = (1 << 63) - 1

PARTIAL = "length long, sha binary, bytes binary, chars long, keep_id long, n long, spilled boolean"
ARROW = pa.schema(
    [("length", pa.int64()), ("sha", pa.binary()), ("bytes", pa.binary()), ("chars", pa.int64()),
     ("keep_id", pa.int64()), ("n", pa.int64()), ("spilled", pa.bool_())]
)


class Owner:
    """The rows of one text: its content hash, the longest original, the smallest id among those, how many."""

    __slots__ = ("sha", "chars", "doc", "n")

    def __init__(self, sha: bytes, chars: int, doc: int | None, n: int):
        self.sha, self.chars, self.doc, self.n = sha, chars, NO_ID if doc is None else doc, n

    def absorb(self, other: Owner) -> None:
        self.n += other.n
        if (-other.chars, other.doc) < (-self.chars, self.doc):
            self.chars, self.doc = other.chars, other.doc


class Node:
    __slots__ = ("label", "owner", "children", "spilled")

    def __init__(self, label: bytes, owner: Owner | None = None):
        self.label, self.owner, self.spilled = label, owner, False
        self.children: dict[int, Node] = {}


def _shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``label`` stand at ``at`` in ``text``."""
    if text.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text[at + low : at + middle] == label[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Byte strings with path compression; at most ``budget`` bytes of labels stay."""

    def __init__(self, budget: int = BUDGET_BYTES):
        self.root, self.budget, self.held = Node(b""), budget, 0
        self.first: bytes | None = None  # never spilled, so that every round settles some text
        self.overflow: list[tuple[bytes, Owner]] = []

    def insert(self, text: bytes, owner: Owner) -> None:
        node, at = self.root, 0
        if self.first is None:
            self.first = text
        while not node.spilled:
            if at == len(text):
                if node.owner is None:
                    node.owner = owner
                else:
                    node.owner.absorb(owner)
                return
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], owner)
                self.held += len(text) - at + NODE_BYTES
                if self.held > self.budget:
                    self._spill()
                return
            shared = _shared(child.label, text, at)
            if shared < len(child.label):
                upper = Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = child = upper
                self.held += NODE_BYTES
            node, at = child, at + shared
        self.overflow.append((text, owner))

    def _sizes(self) -> dict[int, int]:
        """Bytes below and with every node, by identity."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children.values()
        sizes: dict[int, int] = {}
        for node in reversed(order):
            sizes[id(node)] = len(node.label) + NODE_BYTES + sum(sizes[id(c)] for c in node.children.values())
        return sizes

    def _spill(self) -> None:
        """Cut off a large subtree of at most half of what is held, or the largest, beside the path of the first text."""
        sizes, node, at = self._sizes(), self.root, 0
        beside: list[tuple[int, Node, bytes]] = []
        while True:
            own = node.children.get(self.first[at]) if at < len(self.first) else None
            beside += ((sizes[id(c)], c, self.first[:at]) for c in node.children.values() if c is not own)
            if own is None:
                break
            node, at = own, at + len(own.label)
        _, node, path = max(beside, key=lambda b: b[0], default=(0, None, b""))
        if node is None or node.spilled:
            return
        while sizes[id(node)] * 2 > self.held and node.children:
            path += node.label
            node = max(node.children.values(), key=lambda c: sizes[id(c)])
        self.overflow += self.terminals(node, path)
        # No other string has this path's next byte, so one byte of label is enough for what stays.
        self.held -= sizes[id(node)] - NODE_BYTES - 1
        node.label, node.children, node.owner, node.spilled = node.label[:1], {}, None, True

    def terminals(self, top: Node | None = None, path: bytes = b"") -> Iterator[tuple[bytes, Owner]]:
        stack = [(top or self.root, path)]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.owner is not None:
                yield text, node.owner
            stack += ((c, text) for c in node.children.values())


def _rows(found: Iterator[tuple[bytes, Owner]], spilled: bool, with_text: bool) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    size = 0
    for text, o in found:
        doc = None if o.doc == NO_ID else o.doc
        part.append((len(text), o.sha, text if with_text else None, o.chars, doc, o.n, spilled))
        size += len(text)
        if len(part) == 5000 or size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), ARROW)], schema=ARROW)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), ARROW)], schema=ARROW)


def _through_trie(budget: int, final: bool):
    """Partition function: rows (sha, bytes, chars, keep_id, n) to one row per text; ``final`` leaves texts away."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget)
        for batch in batches:
            for row in zip(*batch.columns):  # one row in Python at a time: texts can be long
                sha, text, chars, doc, n = (value.as_py() for value in row)
                trie.insert(text, Owner(sha, chars, doc, n))
            if trie.overflow:
                done, trie.overflow = trie.overflow, []
                yield from _rows(iter(done), True, True)
        yield from _rows(trie.terminals(), False, not final)
        yield from _rows(iter(trie.overflow), True, True)

    return work


def owners(docs: DataFrame, budget: int = BUDGET_BYTES) -> DataFrame:
    """One row per distinct normalised text: length, sha, keep_id and group_size."""
    bare = F.translate(text_or_empty(), BLANKS, "").cast("binary")
    texts = small_batches(docs).select(
        F.unhex(F.sha2(bare, 256)).alias("sha"),
        bare.alias("bytes"),
        F.char_length(text_or_empty()).cast("long").alias("chars"),
        F.col("doc_id").cast("long").alias("keep_id"),
        F.lit(1).cast("long").alias("n"),
    )
    columns = ["sha", "bytes", "chars", "keep_id", "n"]
    pending = texts.mapInArrow(_through_trie(budget, False), PARTIAL)
    found, round_number = None, 0
    while True:
        dealt = pending.repartition("length", "sha") if not round_number else pending.repartition(
            F.xxhash64("length", "sha", F.lit(round_number))
        )
        done = stored(dealt.select(*columns).mapInArrow(_through_trie(budget, True), PARTIAL), "trie-owners")
        fresh = done.filter(~F.col("spilled")).select("length", "sha", "keep_id", F.col("n").alias("group_size"))
        found = fresh if found is None else found.unionByName(fresh)
        pending = done.filter("spilled")
        if pending.isEmpty():
            return found
        round_number += 1


def exact_dedup(docs: DataFrame, budget: int = BUDGET_BYTES) -> DataFrame:
    """Which row of each group of equal texts stays: doc_id, keep_id, group_size, kept, text_sha256; a row per row.

    Uses doc_id and text, other columns are ignored.  Null counts as the empty text, and all empty texts are equal.  Of
    equal texts the one with the most code points stays, then the smallest doc_id; null ids come last.  Rows with
    the doc_id that stays are all kept: they are the same document.  An empty table gives no rows.
    """
    bare = F.translate(text_or_empty(), BLANKS, "").cast("binary")
    rows = stored(docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(bare, 256)).alias("sha")), "text-digests")
    found = owners(docs, budget).drop("length")
    looked_up = lookup_groups(rows, found, ["sha"], "group_size", rows.count())
    return looked_up.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, budget: int = BUDGET_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps (known by doc_id and normalised text)."""
    kept = exact_dedup(docs, budget).filter("kept")
    kept = kept.select(F.col("doc_id").alias("_keep"), F.unhex("text_sha256").alias("_sha")).distinct()
    bare = F.translate(text_or_empty(), BLANKS, "").cast("binary")
    same = docs["doc_id"].cast("long").eqNullSafe(kept["_keep"]) & (F.unhex(F.sha2(bare, 256)) == kept["_sha"])
    return docs.join(kept, same, "left_semi")
