"""Byte-level ids against the library itself, and exact round trips."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftbook.llm import byte_pairs
from weftbook.llm.queries import QUERIES

PATTERN = public_tokenizers.PATTERN


def loaded(name):
    path = public_tokenizers.path(name)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_pairs.ByteVocabulary(path, PATTERN), library


BOTH = {name: loaded(name) for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")}
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")

ODD = [
    "", " ", "   ", "a", " a", "a  b ", "a \n b\n\n c \t", "\n", " \n x", "é é ﬁ", "don't WE'LL 's's", "<|endoftext|> x", "漢字かな ✓ 😛 𐍈",
    "x" * 3000, " " * 500 + "y", "ab" * 700, "the " * 50, "a\x1cb \x1c c \x1f\x1f d", "a b   c　 d  e \x85f", "1234567 89 ²½",
    "\0\0 \0", "=" * 200 + " " + "-=" * 99, "é i̇ ", "a​ b‍ ", "aaaaaaaab aaab aab" * 30,
]


def ids(vocabulary, texts):
    return [np.frombuffer(raw, "<u4").tolist() for raw in vocabulary.encode(texts)]


@pytest.mark.parametrize("name", BOTH)
def test_odd_texts(name):
    own, library = BOTH[name]
    own.forget()
    wanted = [library.encode_ordinary(t) for t in ODD]
    assert ids(own, ODD) == wanted
    assert ids(own, ODD) == wanted  # from what is remembered
    assert [ids(own, [t])[0] for t in ODD] == wanted
    assert [own.decode(raw) for raw in own.encode(ODD)] == [t.encode() for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeinorst THE.,'\n\t\x1c1é漢"), max_size=90), max_size=5))
def test_any_text(texts):
    for own, library in BOTH.values():
        own.forget()
        assert ids(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_code_points():
    own, library = BOTH["byte_bpe_50k.tiktoken"]
    texts = []
    for block in [*range(0, 0x20000, 256), 0xE0000, 0x10FF00]:
        points = [chr(c) for c in range(block, block + 256) if not 0xD800 <= c < 0xE000]
        texts.append("".join(f"a{c}b {c}1 {c} {c}\n" for c in points))
    wanted = library.encode_ordinary_batch(texts)
    for text, found, right in zip(texts, ids(own, texts), wanted):
        assert found == right, text[:200]
    own.forget()


def test_merges_follow_ranks_word_by_word(tmp_path):
    """A merge that opens an earlier one: 'bc' (rank 257) makes 'abc' (rank 256) possible before the next 'bc'."""
    lines = [(bytes([b]), b) for b in range(256)] + [(b"abc", 256), (b"bc", 257), (b"abca", 258), (b"cabc", 259), (b"bca", 260)]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in lines))
    own = byte_pairs.ByteVocabulary(str(path), PATTERN)
    library = tiktoken.Encoding("made", pat_str=PATTERN, mergeable_ranks=dict(lines), special_tokens={})
    texts = ["abcabcabc", "bcbcabca", "abcabc bcabca", "cabcabcabcabca" * 5]
    assert ids(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_memory_is_bounded(monkeypatch):
    own, library = BOTH["byte_bpe_50k.tiktoken"]
    own.forget()
    monkeypatch.setattr(byte_pairs, "KEPT_BYTES", 5000)
    monkeypatch.setattr(byte_pairs, "REPLAY_BYTES", 100)
    monkeypatch.setattr(byte_pairs, "CHUNK_CHARS", 300)
    for at in range(40):
        texts = [f"word{at} and{i} other{at * i} " + "y" * (at * 10) for i in range(20)]
        assert ids(own, texts) == [library.encode_ordinary(t) for t in texts]
        assert own.kept < 5000 + 20 * 3 * 300 and all(len(s) <= byte_pairs.LONG for part in own.known for s in part)
    own.forget()


def expected(texts):
    _, library = BOTH["byte_bpe_50k.tiktoken"]
    for doc, text in texts:
        found = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        yield doc, len(found) // 4, hashlib.sha256(found).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op11_merge_replay"](spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in rows.collect()) == sorted(expected(texts))


def test_nulls_repeats_and_extra_columns(spark):
    texts = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "z" * 200_000), (3, "z" * 200_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, ids string")
    rows = byte_pairs.round_trip(docs, PATH, PATTERN).collect()
    assert sorted((r[0] or 0, *r[1:]) for r in rows) == sorted((r[0] or 0, *r[1:]) for r in expected(texts))
    assert byte_pairs.round_trip(docs.filter("false"), PATH, PATTERN).count() == 0
