"""Harmonic packing against the tokenizer itself and the rules of sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftbook.llm import packing
from weftbook.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, capacity):
    """Every id in exactly one piece, sequences gapless, padding only where a length is no power of two."""
    whole = Tokenizer.from_file(PATH)
    wanted = {d: np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(wanted)
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(wanted[doc])
            assert p.ids_crc32 == zlib.crc32(wanted[doc][at : at + p.length].tobytes())
            at += p.length
        assert at == len(wanted[doc])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check(QUERIES["op2_harmonic_packing"](spark, sf_dir).collect(), docs, 2048) == 0


ODD = [
    "", " \t\n", "It's A-Z 12ab ²³ don't WE'LL", "é́ ﬁ  x y z\x1cw", "İstanbul ΟΔΟΣ", "<|endoftext|> <|x",
    "a" * 5000, "漢字 かな", "ÀÉÎ ßÿ", "x's's 'S", "\x85a\x85", "tab\tq\x0bq\x0cq",
]


@pytest.mark.parametrize("text", ODD)
def test_word_ids_are_text_ids(text):
    assert packing.WordTokenizer(PATH, 1).encode([text])[0].tolist() == reference_ids(text)


def test_nulls_repeats_extra_columns_and_small_bins(spark):
    texts = {i: t for i, t in enumerate([None, *ODD, "one two " * 40, "same", "same"])}
    docs = spark.createDataFrame(
        [(i, t, 7, None) for i, t in texts.items()], "doc_id long, text string, start int, sequence_id string"
    )
    for capacity in (4, 16, 2048):
        assert check(packing.piece_digests(packing.pack(docs, PATH, capacity)).collect(), texts, capacity) == 0


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, PATH).count() == 0
    none = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.doc_id for r in packing.pack(none, PATH).collect()] == [None] * packing.pack(none, PATH).count()


def test_class_bins_close_at_their_count():
    packer = packing.HarmonicPacker(12, 0)
    for doc in range(3):
        packer.add(doc, np.arange(4, dtype=np.uint32))
    assert [r[0] for r in packer.rows] == [0, 1, 2]  # class 3 closed with three documents and no gap
    packer.add(3, np.arange(7, dtype=np.uint32))  # class 1, lacks five
    assert len(packer.waiting) == 1
    packer.add(4, np.arange(13, dtype=np.uint32))  # longer than a bin: its first five ids fill the gap
    assert [(r[0], r[1], r[2]) for r in packer.rows[3:]] == [(3, 0, 7), (4, 0, 5)]
