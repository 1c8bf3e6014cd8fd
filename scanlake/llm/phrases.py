"""Removal of repeated passages: recurring phrases, sharded Aho-Corasick automata, and an exact check of every window."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm import text

#: Words of a window and of a phrase; each window holds at least one of the phrases chosen from a text.
WINDOW, PHRASE = 50, 8
#: Phrases of a shard's automaton, and words of the texts that one task streams through it.
SHARD_PHRASES = 20_000
GROUP_WORDS = 1_000_000
CHUNK_CHARS = 4_000_000
#: Digests of texts that a task remembers before it starts anew (a bound on memory, not on results).
CACHE_NODES = 200_000
_U = np.uint64
_LAST = 2**63 - 1


def letters(h: np.ndarray) -> np.ndarray:
    """One 16-bit character for each word hash, the alphabet of the automata. Several words may share one."""
    return (h % _U(0xD800 - 0x100) + _U(0x100)).astype("<u2")


def positions(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the phrases chosen from texts whose word hashes stand one after another in ``h``.

    Of the phrases in each window of a text the one with the smallest hash is chosen, the first on ties: equal windows, wherever
    they stand, choose the same phrase.
    """
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    grams = text.gram_hashes(h, PHRASE)
    low = (grams >> _U(32) << _U(32)) | np.arange(len(grams), dtype=_U)
    width, wanted = 1, WINDOW - PHRASE + 1
    while 2 * width <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (wanted - width)], low[wanted - width :])
    starts = np.cumsum(counts) - counts
    inside = np.zeros(len(h) + 1, np.int64)
    some = counts >= WINDOW
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, (starts + counts - WINDOW + 1)[some], -1)
    chosen = (low[np.cumsum(inside[: len(low)]) > 0] & _U(0xFFFFFFFF)).astype(np.int64)
    return chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))] if len(chosen) else chosen


def hashed(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some texts one after another, and the words of each text."""
    parts = [text.HASHES.of(text.split_words(t)) for t in texts]
    return np.concatenate(parts) if parts else np.zeros(0, _U), np.array([len(p) for p in parts], np.int64)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_words, sha256 (of the words joined by spaces) and phrases: the distinct ones chosen, as letters.

    Of equal texts that a task meets one after another only the first has its phrases; the others have none.
    """

    def rows(batches):
        seen: set[bytes] = set()
        for pdf in batches:
            n, sha, phrases = [], [], []
            if len(seen) > CACHE_NODES:
                seen.clear()
            for at in text.chunks(pdf["text"].str.len().fillna(0).to_numpy(np.int64), CHUNK_CHARS):
                words = [text.split_words(t) for t in pdf["text"].iloc[at]]
                counts = np.array([len(w) for w in words], np.int64)
                h = np.concatenate([text.HASHES.of(w) for w in words])
                place = positions(h, counts)
                data, cut = letters(h).tobytes(), np.searchsorted(place, np.cumsum(counts)[:-1])
                for node, own in zip(pdf["node"].iloc[at], np.split(place, cut)):
                    phrases.append([] if node in seen else list({data[2 * p : 2 * (p + PHRASE)] for p in own.tolist()}))
                    seen.add(node)
                n += counts.tolist()
                sha += [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "node": pdf["node"], "n_words": n, "sha256": sha, "phrases": phrases})

    pairs = docs.select("doc_id", text.digest(F.col("text")).alias("node"), "text")
    return pairs.mapInPandas(rows, "doc_id long, node binary, n_words long, sha256 string, phrases array<binary>")


def automaton_of(phrases):
    """Aho-Corasick automaton of phrases given as letters."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in phrases:
        automaton.add_word(phrase.decode("utf-16-le"))
    automaton.make_automaton()
    return automaton


def occurrences(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate windows of a group of texts: (row, place, two hashes of the window, first document that has the text).

    The confirmed phrases of the group are compiled into an Aho-Corasick automaton over words, one character standing for a word, and
    all its texts are streamed through: a window is a candidate if a phrase occurs in it. Nothing else names candidates. Characters may
    stand for several words, so hits can be false; the two 64-bit hashes of a window, by which windows are compared, are of the words.
    """
    h, counts = hashed(pdf["text"])
    starts = np.cumsum(counts) - counts
    marks = np.zeros(len(h) + 1, np.int64)
    phrases = set().union(*pdf["phrases"])
    if phrases:
        automaton, line = automaton_of(phrases), letters(h).tobytes().decode("utf-16-le")
        for start, n in zip(starts.tolist(), counts.tolist()):
            if n < WINDOW:
                continue
            at = np.fromiter((end for end, _ in automaton.iter(line[start : start + n])), np.int64) - (PHRASE - 1)
            np.add.at(marks, start + np.maximum(at - (WINDOW - PHRASE), 0), 1)
            np.add.at(marks, start + np.minimum(at, n - WINDOW) + 1, -1)
    window = np.flatnonzero(np.cumsum(marks) > 0)
    row = np.searchsorted(starts, window, "right") - 1
    # texts without words share their start with the next one; the last of equal starts is the one that has words
    hashes = []
    for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        value = text.mix(h ^ _U(base >> 1))
        power = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(len(h), _U(base)))))
        back = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(len(h), _U(pow(base, -1, 2**64))))))
        upto = np.concatenate(([_U(0)], np.cumsum(value * power[:-1], dtype=_U)))
        hashes.append(text.mix((upto[window + WINDOW] - upto[window]) * back[window]).view(np.int64))
    first = pdf["rep"].to_numpy(np.int64)[row]
    return row, window - starts[row], hashes[0], hashes[1], first


def smallest(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of equal (a, b): the order that sorts them, and the smallest ``first`` of each row's group, in that order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(first[order], np.flatnonzero(new)) if len(a) else first
    return order, least[group] if len(a) else first


def distinct_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """The windows of one part of a split shard, each once, with the first document of this part that has it."""
    _, _, a, b, first = occurrences(pdf)
    order, least = smallest(a, b, first)
    out = pd.DataFrame({"a": a[order], "b": b[order], "first": least}).drop_duplicates(["a", "b"])
    return out.assign(shard=pdf["shard"].iat[0], part=pdf["part"].iat[0])[["shard", "part", "a", "b", "first"]]


def judge(pdf: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Word ranges to remove from each text of a group; ``others`` are windows that other parts of the shard have earlier."""
    row, place, a, b, first = occurrences(pdf)
    n = len(row)
    order, least = smallest(*(np.concatenate((x, others[c].to_numpy(np.int64))) for x, c in ((a, "a"), (b, "b"), (first, "first"))))
    removed = np.zeros(n + len(others), bool)
    removed[order] = np.concatenate((first, others["first"].to_numpy(np.int64)))[order] > least
    row, place = row[removed[:n]], place[removed[:n]]
    nodes, ranges = [], []
    for r in np.unique(row):
        p = place[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]
        cut = np.flatnonzero(np.diff(p) > WINDOW) + 1
        runs = np.split(p, cut)
        nodes.append(pdf["node"].iat[r]), ranges.append([[int(x[0]), int(x[-1]) + WINDOW] for x in runs])
    return pd.DataFrame({"node": nodes, "ranges": ranges}, dtype=object)


def kept_texts(texts: DataFrame) -> DataFrame:
    """node, n_removed, kept of ``texts`` (node, text, ranges): the words outside all ranges, joined by spaces."""

    def rows(batches):
        for pdf in batches:
            n, kept = [], []
            for t, ranges in zip(pdf["text"], pdf["ranges"]):
                words = text.split_words(t)
                keep = np.ones(len(words), bool)
                for start, end in ranges:
                    keep[start:end] = False
                n.append(len(words) - int(keep.sum()))
                kept.append(b" ".join(w for w, k in zip(words, keep) if k).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"node": pdf["node"], "n_removed": n, "kept": kept})

    return texts.mapInPandas(rows, "node binary, n_removed long, kept string")


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, nodes, cuts): ``scan``; its distinct texts (node, rep, copies, n_words); and what their first documents lose.

    A window repeats if its words also start in a document with a smaller doc_id. Equal texts are one node, judged for its
    smallest doc_id; of the other copies everything repeats, if they have a window at all.

    1. Each text chooses phrases such that equal windows choose the same one. A phrase is confirmed if two distinct texts chose it;
       the phrase table holds its words as letters of the automata.
    2. A phrase belongs to the shard of one text that has it, so the phrases that two texts share meet in few shards. All texts are held
       against the phrase table and go to the shards of their confirmed phrases. One without any has no repeated window: it
       would have chosen the same phrase as the text that it shares the window with.
    3. Each shard compiles its phrases into an automaton and streams its texts through (``occurrences``); the hits name the windows that are compared.
       A shard with many words (a passage that very many documents share) is split by text; its parts reduce their windows to
       distinct ones first, and learn from the others which of them are found earlier elsewhere.
    """
    with text.scratch():
        scanned, nodes, cuts = _find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
        return text.keep(scanned.drop("phrases"), "scanned"), text.keep(nodes, "nodes"), text.keep(cuts, "cuts")


def _find(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    scanned = text.stored(scan(docs), "scanned")
    nodes = text.stored(
        scanned.groupBy("node").agg(
            F.coalesce(F.min("doc_id"), F.lit(_LAST)).alias("rep"), F.count("*").alias("copies"), F.first("n_words").alias("n_words")
        ),
        "nodes",
    )
    # texts go by a short name here; should two share one, each also gets the other's phrases, which adds candidates and no removals
    name = F.xxhash64("node").alias("name")
    chosen = scanned.select(name, F.explode("phrases").alias("phrase"))
    recurring = chosen.groupBy("phrase").agg(F.min("name").alias("source"), F.max("name").alias("other")).where("source <> other")
    recurring = text.stored(recurring.select("phrase", "source"), "recurring")
    shards = recurring.count() // SHARD_PHRASES + 1
    routes = chosen.join(recurring, "phrase").groupBy("name", F.pmod(F.xxhash64("source"), F.lit(shards)).cast("int").alias("shard"))
    routes = routes.agg(F.collect_set("phrase").alias("phrases")).join(nodes.select(name, "node", "rep", "n_words"), "name").drop("name")
    routes = text.stored(routes, "routes")
    loads = routes.groupBy("shard").agg((F.floor(F.sum("n_words") / GROUP_WORDS) + 1).cast("int").alias("parts"))
    needed = routes.select("node", F.when(F.col("rep") < _LAST, F.col("rep")).alias("rep")).distinct()
    texts = text.texts_of(needed, docs)
    groups = routes.join(loads, "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    groups = groups.join(texts, "node").select("shard", "part", "parts", "node", "rep", "phrases", "text")

    split = groups.where("parts > 1").drop("parts").groupBy("shard", "part").applyInPandas(distinct_windows, "shard int, part int, a long, b long, first long")
    # a part has a window once: of equal ones there are at most as many as the shard has parts; all move once and only the later ones are stored
    least = F.min("first").over(Window.partitionBy("shard", "a", "b"))
    later = split.withColumn("least", least).where("first > least").select("shard", "part", "a", "b", F.col("least").alias("first"))
    others = text.stored(later, "windows")
    found = groups.drop("parts").groupBy("shard", "part").cogroup(others.groupBy("shard", "part")).applyInPandas(judge, "node binary, ranges array<array<int>>")
    found = text.stored(found, "ranges").groupBy("node").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return scanned, nodes, kept_texts(texts.join(found, "node").select("node", "text", "ranges"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    Null or empty texts have no words and lose none. A null doc_id comes after all others. Rows equal in doc_id and text are
    judged alike. Texts of fewer than 50 words lose none. Only doc_id and text are read; an empty table gives no rows.
    """
    scanned, nodes, cuts = find_repeats(docs)
    cuts = cuts.select("node", F.col("n_removed").alias("cut"), F.sha2("kept", 256).alias("kept_sha"))
    rows = scanned.join(nodes.select("node", "rep"), "node").join(cuts, "node", "left")
    later = (F.coalesce("doc_id", F.lit(_LAST)) > F.col("rep")) & (F.col("n_words") >= WINDOW)
    return rows.select(
        "doc_id", "n_words", F.when(later, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(later, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha256")).alias("kept_sha256"),
    )


def phrases_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` (and n_chars, if it is a column, brought in line).

    A text that loses nothing stays as it is; of one that does, the other words are joined by spaces, possibly none.
    """
    _, nodes, cuts = find_repeats(docs)
    changed = nodes.join(cuts, "node", "left").where("copies > 1 OR kept IS NOT NULL")
    changed = changed.select(F.col("node").alias("_node"), F.col("rep").alias("_rep"), F.col("n_words").alias("_n"), F.col("kept").alias("_kept"))
    rows = docs.select(text.row_of(docs), text.digest(F.col("text")).alias("node")).join(changed, F.col("node") == F.col("_node"), "left")
    later = (F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(_LAST)) > F.col("_rep")) & (F.col("_n") >= WINDOW)
    now = F.when(later, F.lit("")).otherwise(F.coalesce("_kept", F.col("_row.text")))
    replaced = {"text": now}
    if "n_chars" in docs.columns:
        length = F.length(now).cast(docs.schema["n_chars"].dataType)
        replaced["n_chars"] = F.when(later | F.col("_kept").isNotNull(), length).otherwise(F.col("_row.n_chars"))
    return rows.select(*[replaced.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op7_phrase_automata(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(text.load(spark, sf_dir, "documents"))


OP7_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM x) WHERE f < doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM r, (SELECT unnest(range(50)) AS k)),
m AS (SELECT doc_id, list(j) AS cut FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN cut IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(cut, j)))), ' ') END) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id)"""
