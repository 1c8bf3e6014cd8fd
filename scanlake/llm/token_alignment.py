"""Which tokens of two tokenizers share bytes, by products of sparse token-byte matrices."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm import text

#: Multiplications of one block of a product, and letters that are aligned at once (one longer segment or text is taken whole).
BLOCK, ALIGN_LETTERS = 2_000_000, 400_000
#: Segments that are put together for one call of A, and of B.
JOINED = (50, 200)
#: Letters of the segments a Python worker keeps alignments of before it drops those it rarely met, and the distinct segments that a task
#: counts before it sends the counts on (bounds on memory, not on results).
CACHE_LETTERS, COUNTED_SEGMENTS = 1_500_000, 200_000
#: Most id pairs whose counts are sent to every worker (17 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 4_000_000
#: The characters with the White_Space property (fixed values of the Unicode standard).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NEAR_SPACE = re.compile(f"[{_SPACE}] ")
_BREAK = re.compile(f"(?<=[^{_SPACE}]) ")
_STORES: dict[tuple[str, str], "Segments"] = {}


def blocks(work: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive entries with at most ``most`` work together, or one entry."""
    upto, start = np.cumsum(work), 0
    while start < len(work):
        end = max(start + 1, int(np.searchsorted(upto, most + (upto[start - 1] if start else 0), "right")))
        yield slice(start, end)
        start = end


class Csr:
    """Matrix of zeros and ones by rows: row i has its ones in the columns ``columns[start[i]:start[i + 1]]``."""

    def __init__(self, start: np.ndarray, columns: np.ndarray, width: int):
        self.start, self.columns, self.width = start, columns, width

    @classmethod
    def of_rows(cls, lengths: np.ndarray, columns: np.ndarray, width: int) -> Csr:
        return cls(np.concatenate(([0], np.cumsum(lengths))), columns, width)

    def transpose(self) -> Csr:
        rows = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        lengths = np.bincount(self.columns, minlength=self.width)
        return Csr.of_rows(lengths, rows[np.argsort(self.columns, kind="stable")], len(self.start) - 1)

    def products(self, other: Csr, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, value) of the nonzeros of ``self @ other``, ascending, in blocks of rows.

        Gustavson's way: row i of the product is the sum of the rows of ``other`` that row i names. A block takes at most ``most``
        additions, or one row, so its memory does not follow the size of the product.
        """
        size, own = np.diff(other.start), np.diff(self.start)
        upto = np.concatenate(([0], np.cumsum(size[self.columns])))
        for block in blocks(upto[self.start[1:]] - upto[self.start[:-1]], most):
            named = self.columns[self.start[block.start] : self.start[block.stop]]
            n = size[named]
            row = np.repeat(np.repeat(np.arange(block.start, block.stop), own[block]), n)
            at = np.repeat(other.start[named] - np.cumsum(n) + n, n) + np.arange(n.sum())
            key, value = np.unique(row * other.width + other.columns[at], return_counts=True)
            yield key // other.width, key % other.width, value

    def times(self, vector: np.ndarray) -> np.ndarray:
        """``self @ vector``."""
        upto = np.concatenate(([0], np.cumsum(vector[self.columns])))
        return upto[self.start[1:]] - upto[self.start[:-1]]


class Aligned:
    """Tokens of both tokenizers for some texts, as one block-diagonal problem: ids ``a``, ``b`` of texts ``a_text``, ``b_text``,
    token-byte matrices ``a_bytes``, ``b_bytes`` and token-group matrices ``a_groups``, ``b_groups``. Texts whose joined
    token bytes differ from their own are not ``good`` and have no tokens."""

    def __init__(self, good: np.ndarray, size: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], tables: list[text.Gather]):
        self.good = good
        total = int(size[self.good].sum())
        (self.a, self.a_text), (self.b, self.b_text) = sides
        self.a_bytes, self.b_bytes = (Csr.of_rows(t.size[ids], np.arange(total), total) for t, (ids, _) in zip(tables, sides))
        ends = self.a_bytes.start[1:], self.b_bytes.start[1:]
        cuts = np.intersect1d(*ends, assume_unique=True)
        self.a_group, self.b_group = (np.searchsorted(cuts, e) for e in ends)
        self.a_groups, self.b_groups = (Csr.of_rows(np.ones(len(g), np.int64), g, len(cuts)) for g in (self.a_group, self.b_group))

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of a, token of b, bytes they share) of all that overlap: the product A·Bᵀ of the token-byte matrices."""
        return self.a_bytes.products(self.b_bytes.transpose())

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(id pair of each link, in order of texts, links of each text); a pair is A's id in the high half and B's in the low one."""
        if not len(self.a):
            return np.zeros(0, np.int64), np.zeros(len(self.good), np.int64)
        a, b, _ = (np.concatenate(parts) for parts in zip(*self.links(), strict=True))
        return (self.a[a] << 32) | self.b[b], np.bincount(self.a_text[a], minlength=len(self.good))

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of a, token of b, 1) of all in one group: the product of the token-group matrices."""
        return self.a_groups.products(self.b_groups.transpose())

    def group_link_counts(self) -> np.ndarray:
        """Group links of each token of a, without writing them out."""
        return self.a_groups.times(np.diff(self.b_groups.transpose().start))


class Aligner:
    """The two tokenizers. A reads a space and the text, B the text, before which it puts a space itself."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        # printable bytes stand for themselves, the others for the characters from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        names = [""] * self.a.get_vocab_size()
        for name, i in self.a.get_vocab(with_added_tokens=False).items():
            names[i] = name
        self.a_table = text.Gather([bytes(byte[c] for c in name) for name in names])
        pieces = map(self.b.id_to_piece, range(self.b.vocab_size()))
        self.b_table = text.Gather([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.space = [self.b.piece_to_id("▁")]
        self.names = text.Gather([b"%d," % i for i in range(max(len(self.a_table.size), len(self.b_table.size)))])

    def align(self, texts: list[str], joined: tuple[int, int] | None = None) -> Aligned:
        """The texts, each of them with a space put in front, by both tokenizers.

        With ``joined`` so many texts, with the spaces between them, go through a tokenizer in one call. That needs texts
        that both read alike wherever they stand (``plain``); should the result show that they do not, each goes alone.
        """
        data = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, data), np.int64, len(data))
        good, tables = np.ones(len(texts), bool), [self.a_table, self.b_table]
        if joined:
            sides, ends = [], np.cumsum(size)
            for ids, table in zip((self._a(texts, joined[0]), self._b(texts, joined[1])), tables):
                stops = np.cumsum(table.size[ids])
                sides.append((ids, np.searchsorted(ends, stops)))
                if table.of(ids) != b"".join(data) or not np.isin(ends, stops, assume_unique=True).all():
                    return self.align(texts)
            return Aligned(good, size, sides, tables)
        rows = [[e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], [ids or self.space for ids in self.b.encode(texts, num_threads=1)]]
        for k, (a, b) in enumerate(zip(*rows)):
            good[k] = data[k] == b"".join(map(self.a_table.one, a)) == b"".join(map(self.b_table.one, b))
        sides = []
        for side in rows:
            n = np.fromiter(map(len, side), np.int64, len(side))
            of = np.repeat(np.arange(len(side)), n)
            sides.append((np.fromiter(chain.from_iterable(side), np.int64, int(n.sum()))[good[of]], of[good[of]]))
        return Aligned(good, size, sides, tables)

    def _a(self, texts: list[str], n: int) -> np.ndarray:
        found = self.a.encode_batch_fast([" " + " ".join(texts[k : k + n]) for k in range(0, len(texts), n)], add_special_tokens=False)
        return np.fromiter(chain.from_iterable(e.ids for e in found), np.int64)

    def _b(self, texts: list[str], n: int) -> np.ndarray:
        return np.fromiter(chain.from_iterable(self.b.encode([" ".join(texts[k : k + n]) for k in range(0, len(texts), n)], num_threads=1)), np.int64)


def plain(segment: str) -> bool:
    """Whether both tokenizers read a segment alike with others around it: it ends in something to cut behind, and has no mark that B takes for a space."""
    return bool(segment) and not segment[-1].isspace() and "▁" not in segment


def alike(found: set[str]) -> Iterator[tuple[list[str], tuple[int, int] | None]]:
    """Segments in blocks for ``align``, with how many of them go through a tokenizer together."""
    together = list(filter(plain, found))
    for names, joined in ((together, JOINED), (list(found.difference(together)), None)):
        for block in blocks(np.fromiter(map(len, names), np.int64, len(names)) + 1, ALIGN_LETTERS):
            yield names[block], joined


def segments(t: str) -> list[str]:
    """The text cut at each space behind a character that is not white space, without those spaces.

    No token of A reaches over such a space, and no piece of B has its mark for a space behind something else; both
    tokenizers therefore read each segment, with its space before it, as they do inside the text.
    """
    return _BREAK.split(t) if t[:1] == " " or _NEAR_SPACE.search(t) else t.split(" ")


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.zeros((max(n, 2 * len(array)), *array.shape[1:]), array.dtype)
    out[: len(array)] = array
    return out


STATS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")
SCORES = ("n_best", "count_sum")


class Segments:
    """Alignments of the segments a worker has met; each distinct one is aligned once while the cache lasts."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.name, self.counts = aligner, None, None
        self.clear()

    def clear(self) -> None:
        self.index, self.groups, self.letters = {}, [], 0
        self.stats, self.scores = np.zeros((1024, len(STATS)), np.int64), np.zeros((1024, len(SCORES)), np.int64)
        self.good, self.used = np.zeros(1024, bool), np.zeros(1024, np.int64)
        self.links, self.start = np.zeros(1024, np.int64), np.zeros(1025, np.int64)

    def shrink(self) -> None:
        """Keep the segments met most often, at most half of what the cache holds."""
        n, names = len(self.groups), list(self.index)
        size, least = np.fromiter(map(len, names), np.int64, n) + 1, 2
        while size[self.used[:n] >= least].sum() > CACHE_LETTERS // 2:
            least *= 2
        keep = np.flatnonzero(self.used[:n] >= least)
        start, self.index = self.start, {names[k]: i for i, k in enumerate(keep.tolist())}
        self.groups, self.letters = [self.groups[k] for k in keep.tolist()], int(size[keep].sum())
        length = start[keep + 1] - start[keep]
        at = np.repeat(start[keep] - np.cumsum(length) + length, length) + np.arange(length.sum())
        self.links, self.start = self.links[at], np.concatenate(([0], np.cumsum(length)))
        self.stats, self.scores, self.good, self.used = self.stats[keep], self.scores[keep], self.good[keep], self.used[keep] // 2

    def attach(self, name: str, counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Score links by these (pairs ascending, counts, is best)."""
        if name != self.name:
            self.name, self.counts = name, counts
            self._score(0, len(self.groups))

    def _score(self, low: int, high: int) -> None:
        if self.counts is None or low == high:
            return
        pairs, counts, best = self.counts
        links = self.links[self.start[low] : self.start[high]]
        # segments that only other tables or texts without tokens have may hold pairs that were never counted
        known = np.isin(links, pairs)
        at = np.searchsorted(pairs, links[known])
        for k, found in enumerate((best[at], counts[at])):
            value = np.zeros(len(links), np.int64)
            value[known] = found
            upto = np.concatenate(([0], np.cumsum(value)))
            self.scores[low:high, k] = np.diff(upto[self.start[low : high + 1] - self.start[low]])

    def _learn(self, new: list[str], joined: tuple[int, int] | None) -> None:
        x, low, n = self.aligner.align(new, joined), len(self.groups), len(new)
        high = low + n
        self.stats, self.scores = _grown(self.stats, high), _grown(self.scores, high)
        self.good, self.used, self.start = _grown(self.good, high), _grown(self.used, high), _grown(self.start, high + 1)
        links, n_links = x.pairs()
        first = int(self.start[low])
        self.links = _grown(self.links, first + len(links))
        self.links[first : first + len(links)] = links
        self.start[low + 1 : high + 1] = first + np.cumsum(n_links)
        shared = np.bincount(x.a_text, x.group_link_counts(), n) if len(x.a) else np.zeros(n)
        ends = np.diff(x.a_group, append=-1) != 0  # last token of each group
        self.stats[low:high] = np.stack([np.bincount(x.a_text, minlength=n), np.bincount(x.b_text, minlength=n), np.bincount(x.a_text[ends], minlength=n), n_links, shared.astype(np.int64)], 1)
        self.good[low:high], self.used[low:high] = x.good, 0
        self.groups += self._lines(x, n)
        self._score(low, high)
        self.index.update(zip(new, range(low, high)))
        self.letters += sum(map(len, new)) + n

    def _lines(self, x: Aligned, n: int) -> list[bytes]:
        """The groups of each text as it is hashed, with ``;`` behind the last."""
        # all tokens in order of group, A's before B's; each is its id and one mark
        place = np.argsort(np.concatenate((2 * x.a_group, 2 * x.b_group + 1)), kind="stable")
        ids, of = np.concatenate((x.a, x.b))[place], np.concatenate((x.a_text, x.b_text))[place]
        step = np.concatenate((2 * x.a_group, 2 * x.b_group + 1))[place]
        line = np.frombuffer(self.aligner.names.of(ids), np.uint8).copy()
        ends = np.cumsum(self.aligner.names.size[ids])
        last = np.diff(step, append=-1) != 0
        line[ends[last & (step % 2 == 0)] - 1], line[ends[last & (step % 2 == 1)] - 1] = ord("|"), ord(";")
        size = np.bincount(of, self.aligner.names.size[ids], n).astype(np.int64)
        at, whole = np.concatenate(([0], np.cumsum(size))).tolist(), line.tobytes()
        return [whole[p:q] for p, q in zip(at, at[1:])]

    def codes(self, parts: list[str]) -> np.ndarray:
        """Number of each segment."""
        found = list(map(self.index.get, parts))
        if None in found:
            new = {p for p, f in zip(parts, found) if f is None}
            for names, joined in alike(new):
                self._learn(names, joined)
            found = list(map(self.index.__getitem__, parts))
        return np.fromiter(found, np.int64, len(found))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segments of all texts, first segment of each text, is good): texts that are null or empty are not good."""
        parts = [segments(t or "") for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = self.codes([p for x in parts for p in x])
        self.used[: len(self.groups)] += np.bincount(codes, minlength=len(self.groups))
        first = np.cumsum(n) - n
        return codes, first, np.logical_and.reduceat(self.good[codes], first) & np.fromiter(map(bool, texts), bool, len(texts))


def store(paths: tuple[str, str]) -> Segments:
    """The alignments of this Python worker."""
    if paths not in _STORES:
        _STORES[paths] = Segments(Aligner(*paths))
    return _STORES[paths]


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _slices(texts: list[str | None]) -> Iterator[slice]:
    return text.chunks(np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts)), ALIGN_LETTERS)


def _ids(df: DataFrame) -> DataFrame:
    """``pair`` as the two ids in it."""
    return df.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int").alias("b_id"), *[c for c in df.columns if c != "pair"])


def _segment_counts(docs: DataFrame, paths: tuple[str, str], bad: frozenset[str]) -> DataFrame:
    """segment and n, how often it occurs in texts with tokens: those that hold none of the ``bad`` segments, which a tokenizer alters."""

    def rows(batches):
        found: Counter[str] = Counter()

        def counted():
            out = pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["segment", "n"])
            found.clear()
            return out

        for batch in batches:
            for t in batch["text"]:
                t = t.as_py()
                if t and "▁" not in t:
                    parts = segments(t)
                    if not bad or bad.isdisjoint(parts):
                        found.update(parts)
                if len(found) > COUNTED_SEGMENTS:
                    yield counted()
        yield counted()

    return docs.select("text").mapInArrow(rows, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def _pair_counts(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def rows(batches):
        aligner = store(paths).aligner
        for batch in batches:
            times = dict(zip(batch["segment"].to_pylist(), batch["n"].to_pylist()))
            for names, joined in alike(set(times)):
                x = aligner.align(names, joined)
                links, of = x.pairs()
                n = np.repeat(np.fromiter(map(times.__getitem__, names), np.int64, len(names)), of)
                pairs, at = np.unique(links, return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, at, n)
                altered = [names[k] for k in np.flatnonzero(~x.good)]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(pairs), pa.nulls(len(altered), pa.int64())]), pa.concat_arrays([pa.array(total), pa.nulls(len(altered), pa.int64())]), pa.array([None] * len(pairs) + altered, pa.string())],
                    ["pair", "n", "altered"],
                )

    # a text with a segment that a tokenizer alters has no tokens: should such segments turn up, their texts are left out and all is counted again
    bad: frozenset[str] = frozenset()
    while True:
        partial = text.stored(_segment_counts(docs, paths, bad).mapInArrow(rows, "pair long, n long, altered string"), "pair-parts")
        found = frozenset(r["altered"] for r in partial.where("altered IS NOT NULL").select("altered").distinct().collect())
        if not found:
            break
        bad |= found
    counts = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    # a B id meets at most as many A ids as there are in their vocabulary
    highest = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))
    return text.stored(counts.select("pair", "n", (F.col("n") == highest).alias("best")), "pair-counts")


def pair_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """a_id, b_id, n and best of all id pairs that are linked in ``docs``: how many links hold the pair, and whether no other A id is
    linked to the B id more often (ties are all best). Tasks count their distinct segments, and each distinct segment of the corpus is aligned once."""
    return _ids(_pair_counts(docs, paths or tokenizer_paths()))


def token_links(docs: DataFrame, paths: tuple[str, str] | None = None, shared: bool = False) -> DataFrame:
    """doc_id, a, b, a_id, b_id, n_bytes of every link: numbers (from 0) and ids of an A and a B token whose byte ranges overlap.

    With ``shared``, of all pairs inside one group instead (n_bytes null). Texts without tokens have none. Written out in blocks of a
    product's rows, so memory does not follow the number of links.
    """
    paths = paths or tokenizer_paths()

    def rows(batches):
        aligner = store(paths).aligner
        for batch in batches:
            for doc_id, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                x = aligner.align([t]) if t else None
                for a, b, value in (x.group_links() if shared else x.links()) if x else ():
                    columns = [pa.array([doc_id] * len(a), pa.int64()), pa.array(a), pa.array(b), pa.array(x.a[a].astype(np.int32)), pa.array(x.b[b].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(a), pa.int64()) if shared else pa.array(value)], ["doc_id", "a", "b", "a_id", "b_id", "n_bytes"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pairs.mapInArrow(rows, "doc_id long, a long, b long, a_id int, b_id int, n_bytes long")


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: tokens of both, groups, links, group links, and what all documents together say about its links.

    n_best counts the links whose pair is the most frequent one of its B id, count_sum adds up the frequencies of its links;
    groups_sha256 is the hash of the groups. Null and empty texts, and those that a tokenizer does not give back byte for byte, have
    zeros and ``''``, and their links count nowhere. Repeated rows count each. An empty table gives no rows. Only doc_id and text are read.

    Two passes over the texts: the first counts the distinct segments, which are then aligned once each, weighted by their counts; the
    second aligns what it has not met and looks the counts up. Up to ``broadcast_pairs`` pairs, a few
    megabytes, go to the workers; beyond that the pairs of each different list of groups are joined to the counts.
    """
    paths = paths or tokenizer_paths()
    counts = _pair_counts(docs, paths)
    few = counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    sent = None
    if few:
        table = counts.orderBy("pair").toArrow()
        sent = docs.sparkSession.sparkContext.broadcast([table[c].to_numpy() for c in ("pair", "n", "best")])
    name, value = counts.stored_at, STATS + (SCORES if few else ())

    def rows(batches):
        s = store(paths)
        if few:
            s.attach(name, sent.value)
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            for block in _slices(texts):
                codes, first, good = s.texts(texts[block])
                sums = np.concatenate([np.add.reduceat(x[codes], first) for x in (s.stats, s.scores)], 1) * good[:, None]
                last, groups = np.append(first[1:], len(codes)), s.groups
                hashes = [hashlib.sha256(b"".join([groups[c] for c in codes[p:q].tolist()])[:-1]).hexdigest() if g else "" for p, q, g in zip(first, last, good)]
                columns, names = [ids[block], *map(pa.array, sums.T[: len(value)]), pa.array(hashes)], ["doc_id", *value, "groups_sha256"]
                if not few:
                    pairs = [np.unique(np.concatenate([s.links[s.start[c] : s.start[c + 1]] for c in codes[p:q]]), return_counts=True) if g else None for p, q, g in zip(first, last, good)]
                    columns.append(pa.array([[{"pair": int(a), "m": int(m)} for a, m in zip(*p)] if p else [] for p in pairs], pa.list_(pa.struct([("pair", pa.int64()), ("m", pa.int64())]))))
                    names.append("pairs")
                yield pa.RecordBatch.from_arrays(columns, names)
                if s.letters > CACHE_LETTERS:
                    s.shrink()

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in value), "groups_sha256 string", *([] if few else ["pairs array<struct<pair: long, m: long>>"])])
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
    if not few:
        out = text.stored(out, "alignments")
        pairs = out.dropDuplicates(["groups_sha256"]).select("groups_sha256", F.inline("pairs")).join(counts, "pair")
        scores = pairs.groupBy("groups_sha256").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
        out = out.drop("pairs").join(scores, "groups_sha256", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in SCORES})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def op13_incidence_products(spark, sf_dir: str) -> DataFrame:
    return align_documents(text.load(spark, sf_dir, "documents"))
