"""Best-fit packing of token pieces into sequences: exact complements first, then best fit for the rest."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm import text

#: Tokens of a sequence, and pieces of one length that are numbered in one group.
SEQUENCE = 2048
GROUP_ROWS = 50_000
#: Most words a Python worker keeps token ids of before it starts anew (a bound on memory, not on results), and words encoded at once.
CACHE_WORDS = 600_000
ENCODE_WORDS = 20_000
_ENCODERS: dict[str, "WordIds"] = {}


class WordIds:
    """Token ids (little-endian bytes) of white-space separated words; each distinct word is encoded once while the cache lasts.

    The tokenizer drops white space before it looks for tokens, so a text's ids are those of its words one after another. It
    also puts text in lower case, and never joins a letter with one of the marks behind it; doing both first leaves fewer words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.ids = Tokenizer.from_file(path), {}
        self.comma = np.array(self._encode([","])[0], "<u4")

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        names = [w.decode("utf-8", "replace") for w in new]
        plain = [k for k, w in enumerate(names) if w.isalpha()]
        # words of letters only are encoded many at once, with commas between them to tell their ids apart
        for i in range(0, len(plain), ENCODE_WORDS):
            groups = [plain[j : j + 50] for j in range(i, min(i + ENCODE_WORDS, len(plain)), 50)]
            for group, ids in zip(groups, self._encode([" , ".join(names[k] for k in g) for g in groups])):
                ids = np.array(ids, "<u4")
                cut = np.flatnonzero(ids == self.comma[0])
                data = ids.tobytes()
                for k, start, end in zip(group, [0, *(cut + 1)], [*cut, len(ids)], strict=True):
                    self.ids[new[k]] = data[4 * start : 4 * end]
        other = [k for k, w in enumerate(names) if not w.isalpha()]
        for i in range(0, len(other), ENCODE_WORDS):
            group = other[i : i + ENCODE_WORDS]
            for k, ids in zip(group, self._encode([names[k] for k in group])):
                self.ids[new[k]] = np.array(ids, "<u4").tobytes()

    def texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text)."""
        texts = pc.fill_null(texts, "")
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-zß-öø-ÿ])([.,!#$%&*|])", r"\1 \2")
        # the name of a special token is one token, in its own case only
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, plain))
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.ids.get, names))
        missing = {w for w, x in zip(names, found) if x is None} - {b""}
        self.ids[b""] = b""
        if missing:
            if len(self.ids) + len(missing) > CACHE_WORDS:
                self.ids.clear()
                self.ids[b""] = b""
                missing = set(names) - {b""}
            self._learn(list(missing))
        found = list(map(self.ids.__getitem__, names))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        word = coded.indices.to_numpy(zero_copy_only=False)
        n = size[word]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(start[word] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, np.diff(upto[words.offsets.to_numpy()])


def word_ids(path: str) -> WordIds:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A document is its token ids and then ``end``.

    Null and empty texts are the one token ``end``. Only documents of more than ``size`` tokens are cut.
    """
    def rows(batches):
        encoder = word_ids(path)
        encoder.ids.clear()  # what other tasks of this worker left would only fill its memory
        for batch in batches:
            ids, counts = encoder.texts(batch["text"])
            # the end mark of each document behind its ids
            ids = np.insert(ids, np.cumsum(counts), end)
            counts = counts + 1
            pieces = -(-counts // size)
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(counts[row] - piece * size, size)
            data, at = memoryview(ids.astype("<u4").tobytes()), 4 * (np.cumsum(length) - length)
            crc = [zlib.crc32(data[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * size), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        encoder.ids.clear()

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return pairs.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Counts:
    """Pieces left of each length, and the exact combinations that fill a gap."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two lengths that fill the gap, the longest possible first."""
        if gap < 2:
            return None
        large = np.arange(gap - 1, (gap - 1) // 2, -1)
        small = gap - large
        good = np.flatnonzero((self.left[large] > (large == small)) & (self.left[small] > 0))
        return (int(large[good[0]]), int(small[good[0]])) if len(good) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for first in np.flatnonzero(self.left[: max(gap - 1, 0)])[::-1]:
            self.left[first] -= 1
            rest = self.pair(gap - int(first))
            self.left[first] += 1
            if rest and rest[0] <= first:
                return (int(first), *rest)
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        if gap == 0:
            return ()
        if self.left[gap] > 0:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan_sequences(counts: np.ndarray, size: int = SEQUENCE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """How to pack ``counts[length]`` pieces: (pattern, times), a pattern being runs (length, repeats) with a sum of at most ``size``.

    Longest pieces first. Each looks for one, two or three pieces that fill its sequence exactly; the combination is used as
    often as the counts allow. What finds none is packed by best fit, longest first. Works on counts, so its cost depends on
    the number of lengths and not on the number of pieces.
    """
    index, plan, rest = Counts(counts), [], np.zeros(size + 1, np.int64)
    for length in range(size, 0, -1):
        while index.left[length] > 0:
            index.left[length] -= 1
            found = index.fill(size - length)
            index.left[length] += 1
            if found is None:
                rest[length] = index.left[length]
                index.left[length] = 0
                break
            use, need = np.unique((length, *found), return_counts=True)
            times = int((index.left[use] // need).min())
            index.left[use] -= times * need
            plan.append((tuple((int(a), int(b)) for a, b in zip(use[::-1], need[::-1])), times))
    # best fit: open sequences by gap, alike ones together
    open_at: dict[int, list[tuple[tuple, int]]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: tuple, times: int) -> None:
        if gap not in open_at:
            insort(gaps, gap)
            open_at[gap] = []
        open_at[gap].append((pattern, times))

    for length in range(size, 0, -1):
        left = int(rest[length])
        while left:
            i = bisect_left(gaps, length)
            if i == len(gaps):  # none has room: open new ones, each filled with as many as fit
                each = min(size // length, left)
                times = left // each
                put(size - each * length, ((length, each),), times)
                left -= times * each
                continue
            gap = gaps[i]
            pattern, times = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap], gaps[i]
            each = min(gap // length, left)
            use = min(times, left // each)
            if use < times:
                put(gap, pattern, times - use)
            put(gap - each * length, (*pattern, (length, each)), use)
            left -= use * each
    plan += [entry for group in open_at.values() for entry in group]
    return plan


def ranges(plan: list, size: int = SEQUENCE) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, times, repeats, first sequence, offset). Rank r lies in copy (r - first) // repeats of the pattern."""
    used, sequence, out = np.zeros(size + 1, np.int64), 0, {}
    for pattern, times in plan:
        offset = 0
        for length, repeats in pattern:
            out.setdefault(length, []).append((used[length], times, repeats, sequence, offset))
            used[length] += times * repeats
            offset += length * repeats
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    The counts of the lengths (at most ``size`` numbers) come to the driver and are packed there; the plan, of a few rows for each
    length, goes back. Pieces of one length are numbered in groups of about ``GROUP_ROWS``, found by hash, so no task holds
    all pieces of a frequent length; the number of a piece says where in the plan it goes.
    """
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    plan = ranges(plan_sequences(counts, size), size)
    groups = F.element_at(F.lit([int(n) // GROUP_ROWS + 1 for n in counts[1:]]), F.col("length").cast("int"))
    order = ["doc_id", "piece", "ids_crc32"]
    df = pieces.withColumn("_group", F.pmod(F.xxhash64(*order), groups))
    sizes = df.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    df = df.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy(*order)) - 1)
    df = df.join(sizes, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_group", "_before")

    def place(batches):
        for pdf in batches:
            lengths, ranks = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                table = plan[int(length)]
                first, _, repeats, start, off = table[np.searchsorted(table[:, 0], ranks[at], "right") - 1].T
                copy, turn = np.divmod(ranks[at] - first, repeats)
                sequence[at], offset[at] = start + copy, off + turn * length
            yield pdf.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return df.select(*columns, "_rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents, packed. Only doc_id and text are read.

    Null and empty texts are one token. Repeated rows are packed each; ties are numbered by doc_id, piece and checksum, rows equal
    in all of them arbitrarily. An empty table gives no rows. Texts are encoded once; the stored pieces are narrow.
    """
    return pack(text.stored(cut_pieces(docs, path or tokenizer_path(), size), "pieces"), size)


def op8_exact_complement(spark, sf_dir: str) -> DataFrame:
    return pack_documents(text.load(spark, sf_dir, "documents"))
