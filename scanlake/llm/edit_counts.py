"""Token counts that follow edits: a tree of pre-token segments per document, re-encoded only where an edit touches it."""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm import text

#: Segments of a new leaf, and the most distinct segments a Python worker keeps counts of before it starts anew.
LEAF = 32
CACHE_SEGMENTS = 300_000
#: The characters with the White_Space property (fixed values of the Unicode standard).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_IS_SPACE = re.compile(f"[{_SPACE}]")
_COUNTERS: dict[str, "SegmentCounts"] = {}


class SegmentCounts(dict):
    """Tokens of each segment: a run of white space and the word after it.

    The pre-tokenizer never lets a token reach from a word into the white space behind it, so a text's tokens are those of its
    segments one after another.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, segment: str) -> int:
        if len(self) >= CACHE_SEGMENTS:
            self.clear()
        value = self[segment] = len(self.encoding.encode_ordinary(segment))
        return value


def counter(path: str) -> SegmentCounts:
    """The counts of this Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = SegmentCounts(path)
    return _COUNTERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tree:
    """Characters and tokens of a document's leaves, and of every subtree above them (heaps with the root at 1)."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.leaves = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, t: str, counts: SegmentCounts) -> Tree:
        segments = _SEGMENT.findall(t)
        leaves = 1
        while leaves * LEAF < len(segments):
            leaves *= 2
        tree = cls([0] * (2 * leaves), [0] * (2 * leaves))
        tree._fill(0, leaves, segments, counts)
        return tree

    def _fill(self, first: int, n: int, segments: list[str], counts: SegmentCounts) -> None:
        """Deal segments to ``n`` leaves from ``first`` on and renew the sums above them."""
        at = [len(segments) * k // n for k in range(n + 1)]
        for k in range(n):
            part = segments[at[k] : at[k + 1]]
            self.chars[self.leaves + first + k] = sum(map(len, part))
            self.tokens[self.leaves + first + k] = sum(map(counts.__getitem__, part))
        low, high = self.leaves + first, self.leaves + first + n - 1
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character at ``place``."""
        i, start = 1, 0
        while i < self.leaves:
            i *= 2
            if place >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.leaves, start

    def edit(self, t: str, start: int, length: int, replacement: str, counts: SegmentCounts) -> tuple[str, int]:
        """(new text, characters encoded anew) after ``t[start:start + length]`` became ``replacement``.

        The leaves touched and those of the characters before and after are encoded anew. A neighbour joins them while the region
        would start inside a word or end in white space, where tokens could reach over its border.
        """
        start = min(max(start, 0), len(t))
        end = min(start + max(length, 0), len(t))
        new = t[:start] + replacement + t[end:]
        first, low = self.find(max(start - 1, 0))
        last, high = self.find(min(end, max(len(t) - 1, 0)))
        high += self.chars[self.leaves + last] + len(new) - len(t)
        while first > 0 and not (low < high and _IS_SPACE.match(new, low)):
            first -= 1
            low -= self.chars[self.leaves + first]
        while last < self.leaves - 1 and (low == high or _IS_SPACE.match(new, high - 1)):
            last += 1
            high += self.chars[self.leaves + last]
        self._fill(first, last - first + 1, _SEGMENT.findall(new[low:high]), counts)
        return new, high - low


EDITS = "array<struct<start: int, length: int, replacement: string>>"
TREE = "doc_id long, text string, chars array<int>, tokens array<int>"


def build_trees(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and the tree (chars, tokens) of every document; ``tokens[1]`` is the count. A null text counts as empty."""

    def rows(batches):
        counts = counter(path)
        for pdf in batches:
            texts = pdf["text"].fillna("")
            trees = [Tree.build(t, counts) for t in texts]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "chars": [np.array(x.chars, np.int32) for x in trees], "tokens": [np.array(x.tokens, np.int32) for x in trees]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, TREE)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the ``edits`` (doc_id, seq, start, length, replacement) of each document, in order of seq."""
    own = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("edits"))
    own = own.select("doc_id", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["replacement"].alias("replacement"))).alias("edits"))
    return trees.join(own, "doc_id", "left")


def apply_edits(trees: DataFrame, path: str) -> DataFrame:
    """``trees`` after their ``edits``, with n_before (tokens), n_edits and encoded_chars.

    Edits are applied in turn; each refers to the text as the one before left it. Places are clipped to the text, a null
    replacement is empty, a null list has no edits.
    """

    def rows(batches):
        counts = counter(path)
        for pdf in batches:
            texts, chars, tokens, before, n, encoded = [], [], [], [], [], []
            for t, c, k, edits in zip(pdf["text"], pdf["chars"], pdf["tokens"], pdf["edits"]):
                tree, anew = Tree(list(map(int, c)), list(map(int, k))), 0
                before.append(tree.tokens[1])
                edits = edits if edits is not None else []
                for e in edits:
                    t, m = tree.edit(t, e["start"] or 0, e["length"] or 0, e["replacement"] or "", counts)
                    anew += m
                texts.append(t), chars.append(np.array(tree.chars, np.int32)), tokens.append(np.array(tree.tokens, np.int32)), n.append(len(edits)), encoded.append(anew)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "chars": chars, "tokens": tokens, "n_before": before, "n_edits": n, "encoded_chars": encoded})

    return trees.select("doc_id", "text", "chars", "tokens", "edits").mapInPandas(rows, TREE + ", n_before long, n_edits int, encoded_chars long")


def count_edited(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Tokens of every document before and after three edits, and how many characters had to be encoded anew.

    The edits: the start of the text replaces up to 40 characters at a third of it, a title goes in front, and up to 15 characters
    are deleted two thirds in. Null and empty texts have 0 tokens before. Repeated rows count alike. Only doc_id and text are
    read; an empty table gives no rows. Row-wise: no shuffle.
    """
    path = path or tokenizer_path()
    n = F.length("text")

    def edit(start, length, replacement):
        return F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), replacement.alias("replacement"))

    edits = F.array(edit(F.floor(n / 3), 40, F.substring("text", 1, 20)), edit(F.lit(0), 0, F.lit("Title: ")), edit(F.floor(2 * n / 3), 15, F.lit("")))
    done = apply_edits(build_trees(docs, path).withColumn("edits", edits), path)
    return done.select(
        "doc_id", "n_before", F.element_at("tokens", 2).cast("long").alias("n_after"), F.length("text").cast("long").alias("n_chars_after"), "n_edits", "encoded_chars",
        (F.size("chars") / 2).cast("int").alias("n_leaves"),
    )


def op10_edit_aware_counts(spark, sf_dir: str) -> DataFrame:
    return count_edited(text.load(spark, sf_dir, "documents"))
