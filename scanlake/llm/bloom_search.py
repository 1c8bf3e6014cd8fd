"""Ranked lexical search over bit-sliced Bloom signatures: upper bounds from the signatures, exact scores where they may matter."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm import text

#: Bits of a signature for each of its elements (up to twice as many, widths being powers of two), and bits set for each.
ELEMENT_BITS, HASHES = 12, 4
#: Texts and bits of one block, and documents of one block (copies of a text share its column).
BLOCK_TEXTS, BLOCK_BITS, BLOCK_DOCS = 1024, 1 << 24, 1 << 16
#: A term that occurs ``LEVELS[k]`` times is an element of the signature at each level up to k.
LEVELS = np.array([1, 2, 3, *(x for e in range(2, 40) for x in (1 << e, 3 << (e - 1)))], np.int64)
#: Items and characters of the queries that are searched at once; more are searched in several rounds.
QUERY_ITEMS, QUERY_CHARS = 2_000, 4_000_000
#: Most candidate texts whose digests are sent to every executor (about 50 bytes each); more are joined by a shuffle.
BROADCAST_TEXTS = 200_000
_U = np.uint64
# ASCII letters and digits and everything beyond ASCII belong to terms
_APART = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(t: str | None) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased; none for a null text."""
    return t.encode("utf-8", "surrogatepass").lower().translate(_APART).split() if t else []


def places(hashes: np.ndarray, level: int | np.ndarray, width: int) -> np.ndarray:
    """Slices (one row of ``HASHES`` for each element) that elements (term hash, level) set in signatures of ``width`` bits."""
    h = text.mix(hashes + _U(0x9E3779B97F4A7C15) * (np.asarray(level).astype(_U) + _U(1)))
    step = (h >> _U(32)) | _U(1)
    return ((h[:, None] + step[:, None] * np.arange(HASHES, dtype=_U)) & _U(width - 1)).astype(np.int64)


class _Block:
    """Signatures of one width that wait to be written: the slices of each distinct text, its number of terms and its doc_ids."""

    def __init__(self, width: int):
        self.width, self.levels, self.n_docs = width, 0, 0
        self.nodes: dict[bytes, int] = {}
        self.n_terms: list[int] = []
        self.ids: list[list[int | None]] = []
        self.places: list[np.ndarray] = []

    def full(self) -> bool:
        return len(self.nodes) >= BLOCK_TEXTS or len(self.nodes) * self.width >= BLOCK_BITS or self.n_docs >= BLOCK_DOCS

    def row(self) -> dict:
        bits = np.zeros((self.width, len(self.nodes)), bool)
        for k, p in enumerate(self.places):
            bits[p, k] = True
        return {"width": self.width, "levels": self.levels, "nodes": list(self.nodes), "n_terms": self.n_terms, "ids": self.ids, "bits": np.packbits(bits, axis=1).tobytes()}


_INDEX = pa.schema([
    ("width", pa.int64()), ("levels", pa.int32()), ("nodes", pa.list_(pa.binary())), ("n_terms", pa.list_(pa.int64())), ("ids", pa.list_(pa.list_(pa.int64()))), ("bits", pa.binary()),
])


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all documents with a term, stored: one row per block of signatures of one width.

    ``bits`` holds the slices: row s says, a bit per text, in which signatures bit s is set. ``nodes`` are the digests of the block's
    texts, ``ids`` the doc_ids of each (null ids included). A signature's width follows from its text's number of elements, so
    short and long texts are equally sparse. Row-wise: no shuffle. Only doc_id and text are read.
    """

    def rows(batches):
        open_blocks: dict[int, _Block] = {}
        for batch in batches:
            for doc_id, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                t = t.as_py()
                words = terms_of(t)
                if not words:
                    continue
                hashes, tf = np.unique(text.HASHES.of(words), return_counts=True)
                levels = np.searchsorted(LEVELS, tf, "right")
                width = 1 << max(10, (ELEMENT_BITS * int(levels.sum()) - 1).bit_length())
                block = open_blocks.setdefault(width, _Block(width))
                node = hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()
                column = block.nodes.setdefault(node, len(block.nodes))
                block.n_docs += 1
                if column < len(block.ids):
                    block.ids[column].append(doc_id)
                else:
                    of = np.repeat(np.arange(len(hashes)), levels)
                    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
                    block.places.append(places(hashes[of], level, width).ravel())
                    block.n_terms.append(len(words))
                    block.ids.append([doc_id])
                    block.levels = max(block.levels, int(levels.max()))
                if block.full():
                    yield pa.RecordBatch.from_pylist([open_blocks.pop(width).row()], _INDEX)
        for block in open_blocks.values():
            yield pa.RecordBatch.from_pylist([block.row()], _INDEX)

    schema = "width long, levels int, nodes array<binary>, n_terms array<long>, ids array<array<long>>, bits binary"
    return text.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema), "bloom-index")


class Query(NamedTuple):
    """Items with their distinct terms (numbers into ``terms``), and what the corpus says: documents, terms with repeats, a weight per term."""

    items: list[int | None]
    of: list[list[int]]
    terms: list[bytes]
    n_docs: int
    n_terms: int
    weights: list[int]

    def mass(self, n_terms: np.ndarray | int):
        """The length factor m of texts of ``n_terms`` terms."""
        return 50 + (50 * n_terms * self.n_docs) // self.n_terms


def prepare(docs: DataFrame, items: list[tuple[int | None, str | None]]) -> Query:
    """The query over ``items`` (id, text), with document frequencies counted over all of ``docs``. Each task counts the query's terms only."""
    split = [list(dict.fromkeys(terms_of(t))) for _, t in items]
    terms = sorted({w for words in split for w in words})
    number = {w: k for k, w in enumerate(terms)}

    def rows(batches):
        found, n_docs, n_terms, wanted = Counter(), 0, 0, set(terms)
        for batch in batches:
            for t in batch["text"]:
                words = terms_of(t.as_py())
                n_docs += bool(words)
                n_terms += len(words)
                found.update(wanted.intersection(words))
        counted = [*((number[w], n, 0) for w, n in found.items()), (-1, n_docs, n_terms)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*counted)], ["term", "n_docs", "n_terms"])

    partial = docs.select("text").mapInArrow(rows, "term long, n_docs long, n_terms long")
    total = {r["term"]: r for r in partial.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).collect()}
    n_docs, n_terms = (total[-1]["n_docs"], total[-1]["n_terms"]) if -1 in total else (0, 0)
    df = [total[k]["n_docs"] if k in total else 0 for k in range(len(terms))]
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df]
    return Query([i for i, _ in items], [[number[w] for w in words] for words in split], terms, n_docs, n_terms, weights)


class _Bounds:
    """Upper bounds of the scores of a query's items in the texts of a block."""

    def __init__(self, query: Query):
        self.query = query
        self.hashes = text.HASHES.of(query.terms)
        self.weights = np.array(query.weights, np.int64)
        self.some = [k for k, terms in enumerate(query.of) if terms]

    def of(self, block: dict) -> np.ndarray:
        """(item, text) -> bound, for the items in ``some``.

        A term is taken to occur as often as the next level allows, at the highest level at which all its slices have the text's bit
        and those of the levels below do. Signatures only ever claim too much, and a term's part of a score grows with its count.
        """
        n = np.array(block["n_terms"], np.int64)
        slices = np.frombuffer(block["bits"], np.uint8).reshape(block["width"], -1)
        mass, part = self.query.mass(n), np.zeros((len(self.hashes), len(n)), np.int64)
        live, below, lower = np.arange(len(self.hashes)), None, np.zeros(len(n), np.int64)
        for level in range(block["levels"]):
            found = np.bitwise_and.reduce(slices[places(self.hashes[live], level, block["width"])], axis=1)
            if level:
                found &= below
            some = found.any(axis=1)
            live, below = live[some], found[some]
            if not len(live):
                break
            tf = np.minimum(LEVELS[level + 1] - 1, n)
            value = (1_000_000_000 * tf) // (1000 * tf + 20 * mass)
            part[live] += np.unpackbits(below, axis=1, count=len(n)) * (value - lower)
            lower = value
        part *= self.weights[:, None]
        return np.stack([part[self.query.of[k]].sum(axis=0) for k in self.some])


_FOUND = "item int, node binary, bound long, copies long, ids array<long>"
_FOUND_ARROW = pa.schema([("item", pa.int32()), ("node", pa.binary()), ("bound", pa.int64()), ("copies", pa.int64()), ("ids", pa.list_(pa.int64()))])


def _smallest(ids: list[int | None], k: int) -> list[int | None]:
    """The first ``k`` ids in ascending order, nulls first: of texts alike, no others can be among the first k documents."""
    return sorted(ids, key=lambda i: (i is not None, i or 0))[:k]


def _leading(index: DataFrame, query: Query, k: int) -> DataFrame:
    """For each item the ``k`` texts with the highest bounds that each task finds."""

    def rows(batches):
        bounds, best = _Bounds(query), {}
        for batch in batches:
            for block in batch.to_pylist():
                for item, row in zip(bounds.some, bounds.of(block)):
                    top = np.argpartition(-row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                    new = [(int(row[j]), block["nodes"][j], len(block["ids"][j]), _smallest(block["ids"][j], 1)) for j in top if row[j] > 0]
                    best[item] = sorted(best.get(item, []) + new, key=lambda x: -x[0])[:k]
        found = [{"item": i, "node": node, "bound": bound, "copies": copies, "ids": ids} for i, rows in best.items() for bound, node, copies, ids in rows]
        if found:
            yield pa.RecordBatch.from_pylist(found, _FOUND_ARROW)

    return index.mapInArrow(rows, _FOUND)


def _reaching(index: DataFrame, query: Query, least: dict[int, int], k: int) -> DataFrame:
    """Every (item, text) whose bound is not below the item's ``least`` score."""

    def rows(batches):
        bounds = _Bounds(query)
        floor = np.array([max(least.get(i, 1), 1) for i in bounds.some], np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                high = bounds.of(block)
                at, column = np.nonzero(high >= floor[:, None])
                found = [
                    {"item": bounds.some[i], "node": block["nodes"][j], "bound": int(high[i, j]), "copies": len(block["ids"][j]), "ids": _smallest(block["ids"][j], k)}
                    for i, j in zip(at.tolist(), column.tolist())
                ]
                if found:
                    yield pa.RecordBatch.from_pylist(found, _FOUND_ARROW)

    return index.mapInArrow(rows, _FOUND)


def _rescore(found: DataFrame, docs: DataFrame, query: Query) -> DataFrame:
    """item, node and exact score of the distinct (item, node) of ``found``, from the texts themselves; scores of 0 are left out."""
    nodes = text.stored(found.groupBy("node").agg(F.min("ids").alias("ids"), F.collect_set("item").alias("items")), "search-nodes")
    few = nodes.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    reps = nodes.select("node", F.element_at("ids", 1).alias("rep"))
    texts = text.texts_of(F.broadcast(reps) if few else reps, docs).join(nodes.select("node", "items"), "node")

    def rows(batches):
        for batch in batches:
            out = []
            for node, t, items in zip(*(batch[c].to_pylist() for c in ("node", "text", "items"))):
                words = terms_of(t)
                tf, mass = Counter(words), query.mass(len(words))
                for item in items:
                    counts = [(query.weights[k], tf[query.terms[k]]) for k in query.of[item]]
                    out.append((item, node, sum(w * ((1_000_000_000 * n) // (1000 * n + 20 * mass)) for w, n in counts if n)))
            if out:
                item, node, score = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(node, pa.binary()), pa.array(score, pa.int64())], ["item", "node", "score"])

    return texts.select("node", "text", "items").mapInArrow(rows, "item int, node binary, score long").where("score > 0")


def _search(docs: DataFrame, index: DataFrame, query: Query, k: int) -> DataFrame:
    """item (number), rank, doc_id, score."""
    # k documents with high bounds give each item a score that the k-th best document reaches at least
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "node")
    ahead = _leading(index, query, k).groupBy("item", "node").agg(F.max("bound").alias("bound"), F.sum("copies").alias("copies"), F.min("ids").alias("ids"))
    ahead = text.stored(ahead.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k), "search-ahead")
    scored = _rescore(ahead, docs, query).join(ahead.select("item", "node", "copies"), ["item", "node"])
    reached = F.sum("copies").over(Window.partitionBy("item").orderBy(F.desc("score"), "node").rowsBetween(Window.unboundedPreceding, 0))
    least = scored.withColumn("_n", reached).where(F.col("_n") >= k).groupBy("item").agg(F.max("score").alias("score"))
    least = {r["item"]: r["score"] for r in least.collect()}
    # all documents that are not provably below it
    found = text.stored(_reaching(index, query, least, k), "search-found")
    ranked = _rescore(found, docs, query).join(found.select("item", "node", F.explode("ids").alias("doc_id")), ["item", "node"])
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return ranked.select("item", "doc_id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest scores above 0 for each of ``items`` (item_id, text).

    The result is exact: the index (``build_index(docs)`` unless given) only decides which texts are read again. Equal scores go by
    ascending doc_id, null ids first. Repeated documents are ranked each, repeated items too. Items and documents that are null or
    without terms have no rows; neither have empty tables. Texts of any length are searched whole. Copies of a text are scored
    once. Only doc_id, item_id and text are read; items come to the driver in rounds of a bounded size, with their terms' counts.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    rounds = max(n // QUERY_ITEMS, chars // QUERY_CHARS) + 1
    index = build_index(docs) if index is None else index
    out = []
    for r in range(rounds):
        chosen = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r).collect() if rounds > 1 else items.collect()
        query = prepare(docs, [tuple(x) for x in chosen])
        if query.terms and query.n_docs:
            names = docs.sparkSession.createDataFrame(list(enumerate(query.items)), "item int, item_id long")
            out.append(_search(docs, index, query, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2])] + (out[-1:] if len(out) % 2 else [])
    return out[0]


def op11_bloom_signatures(spark, sf_dir: str) -> DataFrame:
    return search(text.load(spark, sf_dir, "documents"), text.load(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), items AS (
    SELECT DISTINCT item_id,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), corpus AS (
    SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0
), counts AS (
    SELECT d, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs
), tf AS (
    SELECT d, doc_id, n, term, count(*) AS tf FROM counts WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, n_docs
), scores AS (
    SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN tf USING (term), corpus GROUP BY item_id, d, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
