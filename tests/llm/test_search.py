"""Ranked search against scores of every document."""

import collections
import math
import random
import re

import pytest

from check import compare, connect
from scanlake.llm import bloom_search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))


def brute(rows, items, k):
    docs = [(d, collections.Counter(terms(t)), len(terms(t))) for d, t in rows]
    docs = [x for x in docs if x[2]]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = collections.Counter(w for _, tf, _ in docs for w in tf)
    for item, t in items:
        scores = []
        for d, tf, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in set(terms(t)) if tf[w])
            if score > 0:
                scores.append((-score, d is not None, d or 0))
        for rank, (score, some, d) in enumerate(sorted(scores)[:k], 1):
            yield item, rank, d if some else None, -score


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    where = f"/root/testdata/{sf}"
    assert compare(spark, connect(where), "op11", bloom_search.op11_bloom_signatures, bloom_search.OP11_SQL, where) is None


def test_search_equals_brute_force(spark, odd, odd_rows):
    rng = random.Random(9)
    words = [w for _, t, *_ in odd_rows if t for w in t.split()]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for k in range(40)]
    items += [(90, None), (91, ""), (92, "!!! ..."), (None, "the of"), (5, "the the THE of"), (5, "the the THE of"), (93, "É é a b here"), (94, "nowhereword")]
    queries = spark.createDataFrame([(*x, "k", 7) for x in items], "item_id long, text string, doc_id string, score int")
    rows = [(d, t) for d, t, *_ in odd_rows]
    for k in (50, 3):
        got = collections.Counter(map(tuple, bloom_search.search(odd, queries, k).collect()))
        assert got == collections.Counter(brute(rows, items, k))


def test_search_with_copies_and_small_blocks(spark, monkeypatch):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(300)], k=rng.choice([3, 20, 60, 400]))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + k, texts[7]) for k in range(400)] + [(None, texts[7])] * 30 + [(5000 - k, texts[k]) for k in range(100)]
    rng.shuffle(rows)
    items = [(k, " ".join(rng.choices(vocabulary, k=8))) for k in range(20)] + [(99, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = bloom_search.build_index(docs)
    blocks = index.collect()
    assert sum(len(ids) for b in blocks for ids in b["ids"]) == len(rows)
    monkeypatch.setattr(bloom_search, "QUERY_ITEMS", 8)
    got = collections.Counter(map(tuple, bloom_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), 20, index).collect()))
    assert got == collections.Counter(brute(rows, items, 20))


def test_bounds_are_never_below_scores_and_rarely_above(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    query = bloom_search.prepare(docs, items)
    bounds, loose, n = bloom_search._Bounds(query), 0, 0
    exact = {(i, d): s for i, _, d, s in brute([(r["doc_id"], r["text"]) for r in docs.collect()], items, 10**6)}
    for block in bloom_search.build_index(docs).collect():
        high = bounds.of(block.asDict())
        for row, k in zip(high, bounds.some):
            for value, ids in zip(row, block["ids"]):
                score = exact.get((query.items[k], ids[0]), 0)
                assert value >= score
                loose, n = loose + (value > 1.5 * score + 10**6), n + 1
    assert n >= 7000 and loose < 0.05 * n


def test_search_empty_tables(spark, nothing):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert bloom_search.search(nothing, items).count() == 0 and bloom_search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in bloom_search.search(docs, items).collect()] == list(brute([(1, "a b")], [(1, "a")], 50))
