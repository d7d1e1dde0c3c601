"""SentencePiece ids against the library itself, and decoding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from weftbook.llm import sentence_pieces
from weftbook.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = sentence_pieces.Vocabulary(PATH)

ODD = [
    "", " ", "   ", "a", " a", "a  b ", "\n\tx", "é é ﬁ", "a▁b ▁", "<s> x </s> <0x0A> <unk>", "　x", "漢字かな交じり文 ✓ 😛 𐍈", "x" * 3000,
    " " * 100 + "y", "the " * 50, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa b", "tokenization " * 3 + "\0end", "İΣ ς", "é",
    "=" * 200 + " " + "-=" * 99,
]


@pytest.mark.parametrize("number", range(len(ODD)))
def test_odd_texts(number):
    text = ODD[number]
    found = OWN.encode([text])[0]
    assert found.tolist() == MODEL.encode(text)
    assert OWN.decode(found) == MODEL.decode(found.tolist())


def test_batch_is_its_texts():
    assert [f.tolist() for f in OWN.encode(ODD)] == [MODEL.encode(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeinorst THE.,▁\né漢"), max_size=90), max_size=5))
def test_any_text(texts):
    fresh = sentence_pieces.Vocabulary.__new__(sentence_pieces.Vocabulary)
    fresh.__dict__.update(OWN.__dict__, known={})
    assert [f.tolist() for f in fresh.encode(texts)] == [MODEL.encode(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 20))
def test_suffix_array(codes, depth):
    order = sentence_pieces.suffix_array(np.array(codes, np.int64), depth)
    prefixes = [tuple(codes[i : i + depth]) for i in order]
    assert prefixes == sorted(prefixes) and sorted(order.tolist()) == list(range(len(codes)))


def test_decode_broken_bytes():
    assert OWN.decode(np.array([3 + 0xC3, 3 + 0x28], np.uint32)) == MODEL.decode([3 + 0xC3, 3 + 0x28])


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_suffix_pieces"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = MODEL.encode(texts[r.doc_id])
        back = MODEL.decode(ids)
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r.decoded_chars, r.decoded_crc32) == (len(back), zlib.crc32(back.encode()))


def test_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (1, None, "x"), (None, "a b", None), (2, "", "y")], "doc_id long, text string, ids string"
    )
    rows = sentence_pieces.round_trip(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_ids, r.decoded_chars) for r in rows) == [(0, 2, 3), (1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert sentence_pieces.round_trip(docs.filter("false"), PATH).count() == 0


def test_suffixes_are_sorted_by_several_codes_at_once(monkeypatch):
    codes = np.random.default_rng(1).integers(32, 128, 5000)
    codes[2000:2500] = codes[:500]
    sorts, argsort = [], np.argsort
    monkeypatch.setattr(sentence_pieces.np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    order = sentence_pieces.suffix_array(codes, 16)
    assert len(sorts) <= 2
    prefixes = [tuple(codes[i : i + 16]) for i in order]
    assert prefixes == sorted(prefixes)


@pytest.mark.parametrize("text", ["▁the▁tokenization▁of▁a▁text", "▁漢字かな▁the✓▁\U0001F61B", "".join(map(chr, range(33, 3000))) + "▁there", "q", "▁" * 40])
def test_edges_are_all_occurrences(text):
    codes = np.array([ord(c) for c in text], np.int64)
    found = [tuple(map(int, edge)) for edge in zip(*OWN.edges(codes))]
    pieces = {p: i for p, i in OWN.normal.items() if len(p) > 1}
    spans = [(a, n) for a in range(len(text)) for n in range(2, OWN.longest + 1) if a + n <= len(text)]
    assert found == [(a, n, pieces[text[a : a + n]]) for a, n in spans if text[a : a + n] in pieces]


def test_known_segments_are_bytes():
    OWN.encode(["some words of a text"])
    assert all(type(ids) is bytes for ids in OWN.known.values())
