"""The trigram index against the scan."""

import numpy as np
import pytest

from weftbook.operators import search, textindex
from weftbook.sources.testviews import Catalogue

TEXTS = [
    "Plain cotton jersey", "50% polyester", "a_c and abc", "back\\slash here", "GRÜßE aus Köln", "ΟΔΟΣ οδος", "İstanbul ISTANBUL", "", None, "ab",
    "\U0001F9F5 thread \U0001F9F5\U0001F9F5 end", "cotton" * 50, "a%b literal", "tri\0gram", "COTTON jersey", "été",
]
QUERIES = [
    "cotton", "COTTON jer", "50%", "a_c", "a\\_c", "a\\%b", "k\\slash", "back\\\\sl", "grüße", "Köln", "οδος", "istanbul", "ab", "", "  ", "%", "_ead",
    "cot%jersey", "c_t%ers", "\U0001F9F5\U0001F9F5 e", "nothing like it", "ÉTÉ", "tri", "nj%cot", "\\", "e%r%s%y",
]


class Tables:
    def __init__(self, spark):
        rows = [
            (i, t, f"t-{i}", TEXTS[-1 - i % len(TEXTS)] if i % 3 else None, "draft" if i % 11 == 10 else "published")
            for i, t in enumerate(TEXTS * 3)
        ]
        rows += [((1 << 18) * i + 5, "cotton far away", f"far-{i}", None, "published") for i in range(1, 4)]
        self.tools = spark.createDataFrame(rows, "id long, name string, slug string, description string, status string")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    tables, root = Tables(spark), str(tmp_path_factory.mktemp("index") / "x")
    textindex.write_index(tables, root, buckets=8, kinds=("tools",))
    return tables, root


@pytest.mark.parametrize("hits", [10, 100])
def test_same_rows_as_the_scan(spark, made, hits):
    tables, root = made
    index = textindex.TextIndex(spark, root, 8)
    for query in QUERIES:
        scan = search.keyword_search("tools", tables.tools, query, hits)
        found = index.search("tools", query, hits)
        assert [r.id for r in found.collect()] == [r.id for r in scan.collect()], query


def test_only_asked_buckets_and_blocks_are_read(spark, made):
    _, root = made
    grams = textindex.query_grams(spark, "far away")
    index = textindex.TextIndex(spark, root, 8)
    found = index.candidates("tools", grams)
    assert sorted(r.block for r in found.collect()) == [1, 2, 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(gram" in plan.split("PushedFilters: [")[1]
    assert [r.slug for r in index.search("tools", "far away").collect()] == ["far-1", "far-2", "far-3"]


def test_literal_parts():
    assert textindex.literal_parts("ab%c_d\\%e\\_\\\\f\\g") == ["ab", "c", "d%e_\\f\\g"]
    assert textindex.literal_parts("%_%") == []


def test_real_tables(spark, sf_dir, tmp_path):
    cat = Catalogue(spark, sf_dir)
    textindex.write_index(cat, str(tmp_path / "x"), buckets=4, kinds=("news", "companies"))
    index = textindex.TextIndex(spark, str(tmp_path / "x"), 4)
    for kind in ("news", "companies"):
        for query in ("the", "er_th", "ing%the", "build"):
            scan = search.keyword_search(kind, getattr(cat, search.TABLE_OF[kind]), query, 1000)
            found = index.search(kind, query, 1000)
            assert [r.id for r in found.collect()] == [r.id for r in scan.collect()]


def test_postings_without_a_row_per_trigram_and_item(spark, made):
    tables, _ = made
    plan = textindex.postings_of("tools", tables.tools)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_first_hits_need_no_join_with_all_candidates(spark, made, monkeypatch):
    tables, root = made
    monkeypatch.setattr(textindex, "NEAR", 4, raising=False)
    index = textindex.TextIndex(spark, root, 8)
    found = index.search("tools", "cotton", 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.id for r in found.collect()] == [r.id for r in search.keyword_search("tools", tables.tools, "cotton", 3).collect()]
    for query in ("cot%jersey", "far away", "cotton%y", "nothing like it"):  # the first candidates are not enough
        scan = search.keyword_search("tools", tables.tools, query, 10)
        assert [r.id for r in index.search("tools", query, 10).collect()] == [r.id for r in scan.collect()], query


@pytest.mark.parametrize("run,keys", [(1 << 20, 1 << 62), (5, 1 << 62), (1 << 20, 1000)])
def test_postings_of_any_texts(monkeypatch, run, keys):
    monkeypatch.setattr(textindex, "RUN_CHARS", run)
    monkeypatch.setattr(textindex, "KEYS", keys)
    texts = [t.lower() if t else t for t in TEXTS]
    ids = [3, -7, (1 << 40) + 1, 3] * (len(texts) // 4)
    batch = textindex.pa.RecordBatch.from_pydict({"id": ids, "a": texts, "b": texts[::-1]})
    found = set()
    for part in textindex._runs(iter([batch, batch])):
        for row in part.to_pylist():
            assert row["places"] == sorted(set(row["places"]))
            found |= {(row["gram"], (row["block"] << textindex.BLOCK_BITS) + p) for p in row["places"]}
    pairs = [(i, t or "") for i, t in [*zip(ids, texts), *zip(ids, texts[::-1])]]
    assert found == {(t[k : k + 3], i) for i, t in pairs for k in range(len(t) - 2)}
    assert list(textindex._postings(np.array([], np.int64), [])) == []


def test_a_kind_without_items(spark, made, tmp_path):
    tables, _ = made

    class Two:
        tools = tables.tools
        companies = tables.tools.where("false").selectExpr("*", "'x' AS address")

    textindex.write_index(Two(), str(tmp_path / "x"), buckets=2, kinds=("companies", "tools"))
    assert len(textindex.TextIndex(spark, str(tmp_path / "x"), 2).search("tools", "far away").collect()) == 3
