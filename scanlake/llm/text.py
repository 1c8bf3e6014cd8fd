"""Words, hashes and shared folders used by the text operators."""

from __future__ import annotations

import threading
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.session import remove_path, shared_path

#: ASCII white space; words are the runs between it.
SPACE = r"[\x20\x09-\x0D]"
#: Most distinct words a Python worker keeps hashes of before it starts anew; a bound on memory, not on results.
CACHE_WORDS = 100_000


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and still there when executors are lost.

    The files go at the end of the ``scratch`` block they were written in; outside of one they stay until the shared folder is cleaned.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if _blocks():
        _blocks()[-1][path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


_SCRATCH = threading.local()


def _blocks() -> list[dict]:
    """The open ``scratch`` blocks of this thread."""
    if not hasattr(_SCRATCH, "blocks"):
        _SCRATCH.blocks = []
    return _SCRATCH.blocks


@contextmanager
def scratch():
    """A block whose stored tables are removed at its end, but for those given to ``keep``: results may only read kept ones."""
    _blocks().append({})
    try:
        yield
    finally:
        for path, spark in _blocks().pop().items():
            remove_path(spark, path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored such that it outlives the innermost ``scratch`` block; the next one out takes it over."""
    out = stored(df, name)
    spark = _blocks()[-1].pop(out.stored_at)
    if len(_blocks()) > 1:
        _blocks()[-2][out.stored_at] = spark
    return out


class WordHashes(dict):
    """64-bit hash of each word (bytes), computed once while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()


def split_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` cuts at exactly the white space of ``SPACE``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes; a shorter non-empty text has one gram of all its words."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return out


def chunks(counts: np.ndarray, most: int):
    """Slices of consecutive texts that hold at most ``most`` words together, or one longer text."""
    start, total = 0, 0
    for i, n in enumerate(counts):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(counts):
        yield slice(start, len(counts))


class Gather:
    """Byte strings by number, fetched many at once and put together."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        return self.data[np.repeat(self.start[ids] - upto + size, size) + np.arange(total)].tobytes()

    def one(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()


def digest(text: Column) -> Column:
    """16 bytes that stand for a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """One row (node, text) for each of ``nodes`` (node, rep): the text with that digest, from the document ``rep``, stored."""
    own = docs.select(F.col("doc_id").alias("rep"), digest(F.col("text")).alias("_node"), "text")
    found = own.join(nodes.withColumnRenamed("rep", "_rep"), (F.col("_node") == F.col("node")) & F.col("rep").eqNullSafe(F.col("_rep")))
    return stored(found.select("node", "text").dropDuplicates(["node"]), "texts")


def row_of(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``_row``, so that columns added beside it cannot clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
