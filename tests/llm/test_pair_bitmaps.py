"""Alignments, corpus counts and scores against a plain computation with whole texts and the two libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftbook.llm import pair_bitmaps
from weftbook.llm.queries import QUERIES

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
OWN = pair_bitmaps.Aligner(A_PATH, B_PATH)


def tokens(text):
    """Ids and byte ranges of both sides, or None."""
    if not text:
        return None
    whole = (" " + text).encode()
    sides = []
    a = A.encode(" " + text, add_special_tokens=False)
    sides.append((a.ids, [pair_bitmaps.unescaped(t) for t in a.tokens]))
    b = B.encode(text)
    pieces = [B.id_to_piece(i) for i in b]
    sides.append((b, [bytes([int(p[3:-1], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]))
    if any(b"".join(raw) != whole for _, raw in sides):
        return None
    out = []
    for ids, raw in sides:
        at, ranges = 0, []
        for i, r in zip(ids, raw):
            ranges.append((i, at, at + len(r)))
            at += len(r)
        out.append(ranges)
    return out


def plain(text):
    """Numbers of tokens, the groups' text and the links of one document."""
    found = tokens(text)
    if not found:
        return 0, 0, "", []
    a, b = found
    links, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links.append((i, b[k][0]))
            k += 1
    ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, x, y = [], 0, 0
    for end in ends:
        left, right = [], []
        while x < len(a) and a[x][2] <= end:
            left.append(str(a[x][0]))
            x += 1
        while y < len(b) and b[y][2] <= end:
            right.append(str(b[y][0]))
            y += 1
        groups.append(",".join(left) + "|" + ",".join(right))
    return len(a), len(b), ";".join(groups), links


def expected(texts):
    rows = [(doc, *plain(text)) for doc, text in texts]
    counts = Counter(link for r in rows for link in r[4])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc, n_a, n_b, groups, links in rows:
        best = sum(counts[link] == most[link[1]] for link in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        n_groups = groups.count(";") + 1 if n_a else 0
        out.append((doc, n_a, n_b, n_groups, len(links), best, sum(counts[link] for link in links), digest))
    return out, counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "   ", "a", " a", "a  b ", "a \n b\n\n c \t", "\n", " \n x", "é é ﬁ", "don't WE'LL 's's", "<|endoftext|> <s> <0x0A>", "a▁b c",
    "漢字かな ✓ 😛 𐍈", "x" * 3000, " " * 500 + "y", "the " * 50, "a\x1cb \x1c c \x1f\x1f d", "a b   c　 d  e \x85f", "\0\0 \0", "a\xa0 \xa0b",
    "=" * 200 + " " + "-=" * 99, "the cat the cat", "the cat the cat", "　wide",
]


def aligned(texts):
    return [b";".join(OWN.groups[n] for n in numbers).decode() for numbers in OWN.numbers([t or "" for t in texts])]


def test_odd_texts():
    OWN.forget()
    assert aligned(ODD) == [plain(t)[2] for t in ODD] == aligned(ODD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abdeinorst THE.,'\n\t\x1cé▁漢0"), max_size=60), max_size=4))
def test_any_text(texts):
    OWN.forget()
    assert aligned(texts) == [plain(t)[2] for t in texts]
    for numbers, text in zip(OWN.numbers(texts), texts):
        pairs = np.frombuffer(b"".join(OWN.pairs[n] for n in numbers), "<i8")
        links = Counter((int(p) >> 40, int(p) >> 16 & 0xFFFFFF) for p in pairs)
        assert links == Counter(plain(text)[3])
    OWN.release()


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 3), st.integers(0, pair_bitmaps.SLOTS - 1)), st.integers(1, 9), min_size=1, max_size=60), st.booleans())
def test_planes(entries, many):
    if many:  # one pair in many documents: a bit field
        entries = {**entries, **{(2, s): 1 + s % 3 for s in range(0, pair_bitmaps.SLOTS, 5)}}
    keys = np.array(sorted(p << 16 | s for p, s in entries))
    counts = np.array([entries[int(k) >> 16, int(k) & 0xFFFF] for k in keys])
    pairs, documents, links, blobs = pair_bitmaps.encode_planes(keys, counts)
    assert pairs.tolist() == sorted({p for p, _ in entries})
    for i, pair in enumerate(pairs.tolist()):
        mine = {s: n for (p, s), n in entries.items() if p == pair}
        assert (documents[i], links[i]) == (len(mine), sum(mine.values()))
    rows, slots, weights = pair_bitmaps.decode_planes(blobs.to_pylist())
    back = Counter()
    for r, s, w in zip(rows.tolist(), slots.tolist(), weights.tolist()):
        back[int(pairs[r]), s] += w
    assert back == entries


def test_whole_table(spark, sf_dir):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op12_pair_bitmaps"](spark, sf_dir)
    assert rows.columns == COLUMNS
    assert sorted(map(tuple, rows.collect())) == sorted(expected(texts)[0])


@pytest.mark.parametrize("slots,entries", [(4096, 600_000), (3, 600_000), (4096, 40)])
def test_hand_made(spark, slots, entries):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(None, "the dog"), (7, "the dog"), (7, "the dog")]
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in texts], "doc_id long, text string, pair string, slot int").coalesce(1)
    wanted, counts = expected(texts)
    found = pair_bitmaps.alignment_digests(docs, A_PATH, B_PATH).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    index = pair_bitmaps.build_index(docs, A_PATH, B_PATH, slots, entries)
    assert (index.select("container").distinct().count() > 1) == ((slots, entries) != (4096, 600_000))
    scored = pair_bitmaps.with_scores(pair_bitmaps.alignments(index), index).collect()
    assert sorted((r.doc_id, r.n_best, r.count_sum) for r in scored if r.doc_id) == sorted((w[0], *w[5:7]) for w in wanted if w[0])
    totals = {(r.a, r.b): (r.documents, r.links) for r in pair_bitmaps.pair_counts(index).collect()}
    assert {k: n for k, (_, n) in totals.items()} == counts
    holders = Counter(link for _, text in texts for link in set(plain(text)[3]))
    assert {k: n for k, (n, _) in totals.items()} == holders
    groups = {r.slot: r.groups for r in pair_bitmaps.align(docs, A_PATH, B_PATH).filter("container = 0").collect()}
    assert groups[0] == "" and len(groups) <= len(texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pair_bitmaps.alignment_digests(docs, A_PATH, B_PATH).count() == 0
