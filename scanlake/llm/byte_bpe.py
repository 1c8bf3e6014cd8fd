"""Byte-level BPE: texts to token ids in overlapping chunks, and token ids back to bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm import text

#: Code points of a chunk, and how many more it shares with the next one. Longer texts are cut.
CHUNK, OVERLAP = 16_384, 256
#: Code points behind a match that the pattern may have looked at: the longest contraction has three.
LOOK = 3
#: Most pieces a Python worker keeps ids of before it starts anew, and the longest piece kept (bounds on memory, not on results).
CACHE_PIECES, CACHE_LETTERS = 400_000, 40
_CODECS: dict[str, "Codec"] = {}


def _class_of(pattern: str) -> str:
    """All characters that the tokenizer library counts to a class of its patterns."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    # without merges the ids of a text are its bytes; what the pattern does not match is left out
    split = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(split.encode_ordinary(every)).decode()


def _ranges(chars: str) -> str:
    """The inside of a regular expression's set for ``chars`` (ascending)."""
    codes = np.fromiter(map(ord, chars), np.int64, len(chars))
    first = np.concatenate(([True], np.diff(codes) > 1))
    pairs = zip(codes[first], codes[np.concatenate((first[1:], [True]))])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in pairs)


class Splitter:
    """``public_tokenizers.PATTERN`` as a regular expression over the tokenizer library's own character classes.

    The two libraries know different versions of Unicode, so the classes are taken from the one that the ids must agree with.
    """

    def __init__(self):
        import public_tokenizers

        letter, number, space = (_class_of(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
        low = [_ranges([c for c in chars if c <= "\uffff"]) for chars in (letter, number, space)]
        self.pieces = {astral: self._compile(public_tokenizers.PATTERN, *sets) for astral, sets in ((False, low), (True, [*map(_ranges, (letter, number, space))]))}
        a, n, s = map(_ranges, (letter, number, space))
        # no piece has a letter before something else, a number before something else, or a mark before white space or a number
        self.certain = re.compile(f"[{a}](?=[^{a}])|[{n}](?=[^{n}])|[^{s}{a}{n}](?=[{s}{n}])")

    @staticmethod
    def _compile(pattern: str, letter: str, number: str, space: str) -> re.Pattern:
        sets = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
        return re.compile(sets.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))

    def split(self, t: str) -> list[str]:
        return self.pieces[bool(t) and max(t) > "\uffff"].findall(t)

    def cut(self, t: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, int, str]]:
        """(number, start, head, tail, chunk text): chunks of about ``size``, the last ``tail`` of one being the first ``head`` of the next.

        Chunks start anywhere, also inside a piece. What two of them share is ``overlap`` code points, and more where needed to
        hold a place where every reading has a piece end, so the readings of both meet there at the latest. A run that is longer
        than a chunk stays whole in one.
        """
        chunk = start = head = 0
        while True:
            end = start + size
            meet = self.certain.search(t, end) if end < len(t) else None
            stop = max(end + overlap, meet.end() + LOOK) if meet else len(t)
            if stop >= len(t):
                yield chunk, start, head, 0, t[start:]
                return
            after = end if meet.end() <= end + overlap else meet.end() - overlap
            yield chunk, start, head, stop - after, t[start:stop]
            chunk, start, head = chunk + 1, after, stop - after


class Codec:
    """Ids of pieces and bytes of ids; each distinct piece is encoded once while the cache lasts."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes_of, self.names = text.Gather(tokens), text.Gather([b" %d" % i for i in range(len(tokens))])
        self.splitter, self.ids = Splitter(), {}

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        out = list(map(self.ids.get, pieces))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    piece = pieces[i]
                    found = out[i] = self.ids.get(piece) or np.array(self.encoding.encode_ordinary(piece), "<u4").tobytes()
                    if len(piece) <= CACHE_LETTERS:
                        if len(self.ids) >= CACHE_PIECES:
                            self.ids.clear()
                        self.ids[piece] = found
        return out

    def encode_text(self, t: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode(self.splitter.split(t))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of.of(ids)


def codec(path: str) -> Codec:
    """The codec of this Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)))


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The list of each row; a null one is empty."""
    return [np.zeros(0, np.int32) if x is None else np.asarray(x.values) for x in lists]


def _short(size: int) -> Column:
    return F.coalesce(F.length("text"), F.lit(0)) <= size


def _long_texts(docs: DataFrame, size: int) -> DataFrame:
    return docs.where(~_short(size)).select(F.col("doc_id").cast("long").alias("doc_id"), text.digest(F.col("text")).alias("node"), "text")


def encode_chunks(texts: DataFrame, path: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """node, part and ids (array) of ``texts`` (node, text): the ids of a text are those of its parts one after another.

    Texts are cut into overlapping chunks that are dealt out by (node, chunk); rows of one node must hold one text and count
    once. Each chunk is split from wherever it starts, and keeps the piece ends in what it shares with its neighbours. The
    first end that two neighbours have in common is where the later one takes over: from there on both read the same.
    """

    def cut(batches):
        splitter = codec(path).splitter
        for batch in batches:
            for node, t in zip(batch["node"], batch["text"]):
                for number, start, head, tail, part in splitter.cut(t.as_py() or "", size, overlap):
                    yield pa.RecordBatch.from_pylist([{"node": node.as_py(), "part": number, "start": start, "head": head, "tail": tail, "text": part}], chunk_schema)

    chunk_schema = pa.schema([("node", pa.binary()), ("part", pa.int32()), ("start", pa.int64()), ("head", pa.int32()), ("tail", pa.int32()), ("text", pa.string())])
    chunks = texts.select("node", "text").mapInArrow(cut, "node binary, part int, start long, head int, tail int, text string").dropDuplicates(["node", "part"])

    def encode(batches):
        c = codec(path)
        for batch in batches:
            ids, heads, tails = [], [], []
            for t, start, head, tail in zip(*(batch[k].to_pylist() for k in ("text", "start", "head", "tail"))):
                pieces = c.splitter.split(t)
                coded = c.encode(pieces)
                ends = np.cumsum([0, *map(len, pieces)])
                upto = np.cumsum([0, *map(len, coded)]) // 4
                first = ends <= head
                last = (ends >= len(t) - tail) & (ends <= len(t) - LOOK) if tail else np.zeros(len(ends), bool)
                heads.append((ends[first] + start, upto[first]))
                tails.append((ends[last] + start, upto[last]))
                ids.append(np.frombuffer(b"".join(coded), "<u4"))
            marks = [_lists([m[k] for m in marks]) for marks in (heads, tails) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["part"], *marks, _lists(ids)], ["node", "part", "head_ends", "head_ids", "tail_ends", "tail_ids", "ids"])

    lists = ", ".join(f"{name} array<int>" for name in ("head_ends", "head_ids", "tail_ends", "tail_ids", "ids"))
    coded = chunks.mapInArrow(encode, f"node binary, part int, {lists}")
    order = Window.partitionBy("node").orderBy("part")
    coded = coded.select("*", F.lag("tail_ends").over(order).alias("_before"), F.lead("head_ends").over(order).alias("_after"))

    def taken(own: str, at: str, other: str, missing: Column) -> Column:
        """Ids before the first end that both chunks have; ``missing`` where there is no other chunk."""
        common = F.element_at(F.array_intersect(own, other), 1)
        met = F.element_at(at, F.array_position(own, common).cast("int"))
        return F.when(F.col(other).isNull(), missing).otherwise(F.coalesce(met, F.raise_error(F.lit("two chunks never meet")).cast("int")))

    first = taken("head_ends", "head_ids", "_before", F.lit(0))
    last = taken("tail_ends", "tail_ids", "_after", F.size("ids"))
    return coded.select("node", "part", "ids", first.alias("_first"), last.alias("_last")).select("node", "part", F.slice("ids", F.col("_first") + 1, F.col("_last") - F.col("_first")).alias("ids"))


def encode_documents(docs: DataFrame, path: str | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, part and ids of every text; the ids of a text are those of its parts in order, and every text has a part 0.

    Only doc_id and text are read. Null and empty texts have one part without ids. Texts of up to ``size`` code points are one
    part and are not shuffled. Longer ones, however long, are encoded once for all their copies. Repeated rows give repeated
    parts, an empty table none.
    """
    path = path or tokenizer_path()

    def rows(batches):
        c = codec(path)
        for batch in batches:
            ids = [c.encode_text(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.zeros(len(ids), np.int32)), _lists(ids)], ["doc_id", "part", "ids"])

    short = docs.where(_short(size)).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, part int, ids array<int>")
    long = _long_texts(docs, size)
    return short.unionByName(long.select("doc_id", "node").join(encode_chunks(long, path, size, overlap), "node").select("doc_id", "part", "ids"))


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (any columns and ids) with the bytes of the ids in place of them. A null list has no bytes."""
    path = path or tokenizer_path()
    keys = [f for f in encoded.schema.fields if f.name != "ids"]

    def rows(batches):
        c = codec(path)
        for batch in batches:
            data = [c.decode(ids) for ids in _arrays(batch["ids"])]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in keys), pa.array(data, pa.binary())], [*(f.name for f in keys), "bytes"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "bytes binary"])
    return encoded.select(*(F.col(f"`{f.name}`") for f in keys), "ids").mapInArrow(rows, schema)


class Digest:
    """Number of ids, hash of the ids as text, and hash of the bytes they stand for, part by part."""

    def __init__(self, c: Codec):
        self.codec, self.n, self.ids, self.decoded = c, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray) -> Digest:
        if len(ids):
            names = self.codec.names.of(ids)
            self.ids.update(names if self.n else memoryview(names)[1:])
            self.decoded.update(self.codec.decode(ids))
            self.n += len(ids)
        return self

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def _digest_batch(key: str, keys: list, digests: list[Digest], kind: pa.DataType) -> pa.RecordBatch:
    n, ids, decoded = zip(*(d.row() for d in digests))
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], [key, *DIGESTS])


def digest_parts(parts: DataFrame, path: str) -> DataFrame:
    """node and the digests of each node's parts in order. A task holds one part at a time."""

    def rows(batches):
        c, node, digest = codec(path), None, None
        for batch in batches:
            keys, done = [], []
            for key, ids in zip(batch["node"].to_pylist(), _arrays(batch["ids"])):
                if key != node:
                    if digest is not None:
                        keys.append(node), done.append(digest)
                    node, digest = key, Digest(c)
                digest.add(ids)
            if keys:
                yield _digest_batch("node", keys, done, pa.binary())
        if digest is not None:
            yield _digest_batch("node", [node], [digest], pa.binary())

    ordered = parts.repartition("node").sortWithinPartitions("node", "part").select("node", "ids")
    return ordered.mapInArrow(rows, "node binary, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids, one space between) and decoded_sha256 (bytes decoded from the ids) of every text.

    Null and empty texts have no tokens and the hashes of nothing. Otherwise as ``encode_documents``; copies of a long text are
    joined to its digests, so their ids are not repeated.
    """
    path = path or tokenizer_path()

    def rows(batches):
        c = codec(path)
        for batch in batches:
            if batch.num_rows:
                digests = [Digest(c).add(c.encode_text(t or "")) for t in batch["text"].to_pylist()]
                yield _digest_batch("doc_id", batch["doc_id"].to_pylist(), digests, pa.int64())

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = docs.where(_short(size)).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
    long = _long_texts(docs, size)
    digests = digest_parts(encode_chunks(long, path, size, overlap), path)
    return short.unionByName(long.select("doc_id", "node").join(digests, "node").select("doc_id", *DIGESTS))


def op12_overlapping_chunks(spark, sf_dir: str) -> DataFrame:
    return round_trip(text.load(spark, sf_dir, "documents"))
