"""Near-duplicate documents by ProbMinHash signatures of weighted shingles, banding and verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scanlake.llm import text
from scanlake.llm.components import components

#: Words of a shingle; bands and rows of a signature: a pair at 0.8 shares no band with probability 3e-6.
SHINGLE = 5
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
#: Pairs whose signatures agree in a smaller share are not verified: at 0.8 that happens with probability 1e-6.
LEAST_ESTIMATE = 0.65
#: Members of a bucket that one task compares with as many others, and words worked on at once.
BLOCK, BLOCK_CHARS = 512, 2_000_000
CHUNK_WORDS = 1_000_000
#: Columns of the table in which shared shingles are counted at once.
COLUMNS = 4096
_U = np.uint64


def weighted_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, weight) of the distinct shingles of some texts, sorted; the weight is how often a shingle occurs.

    A shingle is 40 bits of the hash of five words, or of all words of a shorter text.
    """
    hashes = [text.gram_hashes(text.HASHES.of(text.split_words(t)), SHINGLE) for t in texts]
    owner = np.repeat(np.arange(len(texts), dtype=_U), [len(h) for h in hashes])
    packed = np.sort((owner << _U(40)) | (np.concatenate(hashes) >> _U(24))) if hashes else np.zeros(0, _U)
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    return (packed >> _U(40)).astype(np.int64), packed & _U((1 << 40) - 1), weight.astype(np.float64)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x SIZE signature: the element whose arrival is first at each register.

    Each element is a Poisson process of rate ``weight`` with its own random numbers; an arrival goes to one random register,
    which keeps its earliest. An element is done when it is later than all registers of its text (early termination). Two
    texts agree in a register with a probability equal to the probability Jaccard similarity of their weighted shingles.
    """
    q, z = np.full(n * SIZE, np.inf), np.zeros(n * SIZE, _U)
    seed, time, round_ = text.mix(element + _U(0x632BE59BD9B4E019)), np.zeros(len(element)), 0
    live = np.arange(len(element))
    while len(live):
        round_ += 1
        r = text.mix(seed[live] + _U(round_ * 0x9E3779B97F4A7C15 % 2**64))
        time[live] -= np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        # the register comes from bits that the arrival time hardly uses
        at = owner[live] * SIZE + (text.mix(r ^ _U(0xD1B54A32D192ED03)) % _U(SIZE)).astype(np.int64)
        better = time[live] < q[at]
        at, who = at[better], live[better]
        np.minimum.at(q, at, time[who])
        won = q[at] == time[who]
        z[at[won]] = element[who[won]]
        texts, back = np.unique(owner[live], return_inverse=True)
        live = live[time[live] < q.reshape(n, SIZE)[texts].max(axis=1)[back]]
    return z.reshape(n, SIZE)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the text), bands (one key each; none for a text without words) and sketch (a byte per register)."""

    def rows(batches):
        salt = text.mix(np.arange(1, BANDS + 1, dtype=_U))
        for pdf in batches:
            bands, sketches = [], []
            for at in text.chunks(pdf["text"].str.len().fillna(0).to_numpy(np.int64), 4 * CHUNK_WORDS):
                owner, element, weight = weighted_shingles(pdf["text"].iloc[at].tolist())
                n = at.stop - at.start
                z = signatures(owner, element, weight, n)
                some = np.bincount(owner, minlength=n) > 0
                keys = np.zeros((n, BANDS), _U)
                for k in range(ROWS):
                    keys = text.mix(keys + z.reshape(n, BANDS, ROWS)[:, :, k] + salt)
                sketch = (text.mix(z) >> _U(56)).astype(np.uint8)
                bands += [k if s else [] for k, s in zip(keys.view(np.int64), some)]
                sketches += [x.tobytes() for x in sketch]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "node": pdf["node"], "bands": bands, "sketch": sketches})

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.digest(F.col("text")).alias("node"), "text")
    return pairs.mapInPandas(rows, "doc_id long, node binary, bands array<long>, sketch binary")


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two sorted weighted sets (elements, weights): the chance to agree in a register."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i], b[1][j]
    if x.max() == x.min() == y.max() == y.min() == 1 and a[1].max() == 1 and b[1].max() == 1:
        return len(common) / (len(a[0]) + len(b[0]) - len(common))
    # element e counts 1 / sum over f of max(x_f / x_e, y_f / y_e); f takes the first where x_f / y_f >= x_e / y_e
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    sorted_ratio = ratio[order]
    over = np.append(np.cumsum(x[order][::-1])[::-1], 0.0)  # of x, from this place on
    under = np.append(0.0, np.cumsum(y[order]))  # of y, before this place
    place = np.searchsorted(sorted_ratio, ratio, "left")
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    return float((1.0 / ((over[place] + only_x) / x + (under[place] + only_y) / y)).sum())


@F.pandas_udf(DoubleType())
def text_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Exact similarity of pairs of whole texts; the shingles of a text that repeats from row to row are made once."""
    last: tuple = (None, None)

    def shingles(t):
        _, element, weight = weighted_shingles([t])
        return element, weight

    out = np.zeros(len(left))
    for k, (a, b) in enumerate(zip(left, right)):
        if last[0] != b:
            last = (b, shingles(b))
        out[k] = probability_jaccard(shingles(a), last[1])
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def estimate(left: pd.Series, right: pd.Series) -> pd.Series:
    a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, SIZE) for s in (left, right))
    return pd.Series((a == b).mean(axis=1))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are at least ``least`` similar. ``nodes``: node, rep (its smallest doc_id)."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "rep"), "node")
    texts = text.texts_of(needed, docs)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return text.stored(both.where(text_similarity("ta", "tb") >= least - 1e-9).select("a", "b"), "verified")


def close_sketches(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in at least ``LEAST_ESTIMATE`` of the registers."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return text.stored(both.where(estimate("sa", "sb") >= LEAST_ESTIMATE).select("a", "b"), "candidates")


def shared_counts(row: np.ndarray, element: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left x right matrix of how many elements two of ``n`` sets share; (row, element) are the members of the sets."""
    _, column, times = np.unique(element, return_inverse=True, return_counts=True)
    some = times[column] > 1
    row, column = row[some], (np.cumsum(times > 1) - 1)[column[some]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, (start, start + COLUMNS)))
        table = np.zeros((n, COLUMNS), np.float32)
        table[row[at], column[at] - start] = 1
        out += table[left] @ table[right].T
    return out


def compare_blocks(members: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join different roots within a bucket; ``members``: key, n and chars (of the bucket), node, root, sketch, text.

    A bucket is cut into blocks of about ``BLOCK`` members and ``BLOCK_CHARS`` characters by hash, and each pair of blocks is one
    group of bounded size: all its pairs are compared exactly there, and only links that still join something are given out. So
    a bucket of any size is compared whole, without a row per pair.
    """
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("chars") / BLOCK_CHARS)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    sent = members.withColumn("own", own).select("*", other).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "sketch", "text"
    )

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        block, node, root = pdf["own"].to_numpy(), pdf["node"].tolist(), pdf["root"].tolist()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        row, element, weight = weighted_shingles(pdf["text"].tolist())
        size = np.bincount(row, minlength=len(pdf))
        once = np.bincount(row, weight > 1, len(pdf)) == 0
        code = {x: k for k, x in enumerate(dict.fromkeys(root))}
        group = np.array([code[x] for x in root])
        shared = shared_counts(row, element, len(pdf), left, right)
        apart = group[left][:, None] != group[right][None]
        similar = shared >= (least - 1e-9) * (size[left][:, None] + size[right][None] - shared)
        plain = once[left][:, None] & once[right][None]
        hits = [(left[x], right[y]) for x, y in zip(*np.nonzero(similar & plain & apart))]
        # repeated shingles: exactly, pair by pair, where the signatures agree enough
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, SIZE)
        ends = np.cumsum(size)
        sets = lambda k: (element[ends[k] - size[k] : ends[k]], weight[ends[k] - size[k] : ends[k]])
        for x in range(len(left)):
            for y in np.flatnonzero(~plain[x] & apart[x] & (shared[x] > 0)):
                a, b = left[x], right[y]
                if (sketch[a] == sketch[b]).mean() >= LEAST_ESTIMATE and probability_jaccard(sets(a), sets(b)) >= least - 1e-9:
                    hits.append((a, b))
        parent, a, b = list(range(len(code))), [], []

        def top(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        for x, y in hits:
            one, two = top(group[x]), top(group[y])
            if one != two:
                parent[one] = two
                a.append(node[x]), b.append(node[y])
        return pd.DataFrame({"a": a, "b": b}, dtype=object)

    return sent.groupBy("key", "i", "j").applyInPandas(links, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, node, root, class_id, n_class: the class of each document, links being pairs of at least ``least`` similarity.

    A class is a connected component, named by its root node; class_id is the smallest doc_id in it and n_class its distinct texts. Equal texts are
    one node (null counts as empty; a text without words is only like itself), so copies are never compared. Nodes that share a band
    meet in a bucket; first each is compared with the bucket's smallest node, which joins large groups at a cost of one pair per
    member, then what is still apart within a bucket is compared in blocks. Pairs are verified on whole texts. Null doc_ids
    come after all others in a class. Only doc_id and text are read; an empty table gives no rows.
    """
    with text.scratch():
        return text.keep(_classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least), "classes")


def _classes(docs: DataFrame, least: float) -> DataFrame:
    signed = text.stored(sign(docs), "signed")
    nodes = text.stored(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    buckets = text.stored(bands.join(buckets, "key"), "buckets")

    stars = buckets.where("node <> center").select(F.col("center").alias("b"), F.col("node").alias("a")).distinct()
    links = verified(close_sketches(stars, nodes), nodes, docs, least)
    roots = components(links)

    def rooted(table: DataFrame) -> DataFrame:
        return table.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    # pairs of a centre are done; a bucket is open while its other members have more than one root
    rest = text.stored(rooted(buckets.where("n > 2 AND node <> center").select("key", "node")), "rest")
    still = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = rest.join(still, "key")
    texts = text.texts_of(rest.select("node").distinct().join(nodes.select("node", "rep"), "node"), docs).withColumn("size", F.length("text").cast("long"))
    loads = rest.join(texts.select("node", "size"), "node").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    members = rest.join(loads, "key").join(nodes.select("node", "sketch"), "node").join(texts.select("node", "text"), "node")
    more = text.stored(compare_blocks(members, least), "block-links")
    roots = components(links.unionByName(more))

    named = rooted(nodes.select("node", "rep"))
    classes = named.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n_class"))
    named = named.join(classes, "root").select("node", "root", "class_id", "n_class")
    return signed.select("doc_id", "node").join(named, "node").select("doc_id", "node", "root", "class_id", "n_class")


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id, any one of rows equal in doc_id and text."""
    last = F.lit(2**63 - 1)
    found = near_duplicates(docs, least)
    kept = found.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "node")).alias("kept")).select("kept.id", F.col("kept.node").alias("_node"))
    rows = docs.select(text.row_of(docs), F.coalesce(F.col("doc_id").cast("long"), last).alias("id"), text.digest(F.col("text")).alias("_node"))
    return rows.join(kept, ["id", "_node"]).dropDuplicates(["id", "_node"]).select("_row.*")


def op3_probminhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(text.load(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_class", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
