"""Numbers and hashed terms of a text, for the linear models."""

from __future__ import annotations

import re
import zlib

import numpy as np

from scanlake.llm import text

#: Names of the numeric features, in order.
NUMBERS = (
    "words", "word_length", "short_words", "distinct_words", "upper", "digits", "symbols", "marks", "not_ascii",
    "line_words", "repeated_lines", "repeated_windows", "repeated_next", "top_word",
)
#: Slots that terms are hashed into.
SLOTS = 1 << 18
_TERM = re.compile(r"\w+")


def _shares(data: np.ndarray) -> list[float]:
    c = np.bincount(data, minlength=256) / max(len(data), 1)
    symbols, marks = b"#*$%&|<>", b".,;:!?'\"()-"
    return [c[65:91].sum(), c[48:58].sum(), c[list(symbols)].sum(), c[list(marks)].sum(), c[128:].sum()]


def numbers(t: str | None) -> np.ndarray:
    """The numeric features of one text; all zero without words."""
    words = text.split_words(t)
    n = len(words)
    if not n:
        return np.zeros(len(NUMBERS))
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in t.split("\n") if x.strip()]
    h = text.HASHES.of(words)
    _, times = np.unique(h, return_counts=True)
    windows = text.gram_hashes(h, 8)
    return np.array([
        np.log1p(n), min(lengths.mean(), 30) / 10, (lengths <= 3).mean(), len(times) / n, *_shares(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)),
        np.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), 1 - len(np.unique(windows)) / len(windows), float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        times.max() / n,
    ])


class Slots(dict):
    """Slot of each word (bytes): its letters and digits in lower case, hashed; computed once while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= text.CACHE_WORDS:
            self.clear()
        term = "".join(_TERM.findall(word.decode("utf-8", "replace").lower()))
        value = self[word] = zlib.crc32(term.encode()) % SLOTS if term else -1
        return value


_SLOTS = Slots()


def term_counts(t: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the terms of a whole text."""
    words = text.split_words(t)
    slots, counts = np.unique(np.fromiter(map(_SLOTS.__getitem__, words), np.int64, len(words)), return_counts=True)
    some = slots >= 0
    return slots[some], counts[some].astype(np.float64)
