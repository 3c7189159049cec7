"""Vectorised character statistics over batches of whole texts.

A batch becomes one array of code points and one array of classes, so that a
statistic costs a few nanoseconds a character and no Python loop runs over
characters. Batches are cut by characters, never texts.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLANK, CTRL, HAN, PUNCT, DIGIT, LOWER, UPPER, SYMBOL, OTHER = range(9)

#: Code point ranges that the public BERT basic tokenizer treats as Chinese characters (fixed values).
HAN_RANGES = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)

#: Characters of a batch that are worked on at once.
CHARS_AT_ONCE = 2_000_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, from the Unicode categories."""
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    by = {"Zs": BLANK, "Zl": BLANK, "Zp": BLANK, "Cc": CTRL, "Cf": CTRL, "Nd": DIGIT, "Ll": LOWER, "Lu": UPPER, "Sm": SYMBOL, "So": SYMBOL, "Sc": SYMBOL, "Sk": SYMBOL}
    for cp in range(0x30000):
        cat = unicodedata.category(chr(cp))
        k = by.get(cat, PUNCT if cat[0] == "P" else OTHER)
        if k != OTHER:
            out[cp] = k
    out[0xE0000:0xE0080] = CTRL  # tags
    for a, b in HAN_RANGES:
        out[a : b + 1] = HAN
    for a, b in ((33, 47), (58, 64), (91, 96), (123, 126)):  # all ASCII marks count as punctuation
        out[a : b + 1] = PUNCT
    out[[9, 10, 13]] = BLANK
    out[[0, 0xFFFD]] = CTRL
    return out


def chunks(texts: list[str], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` (CHARS_AT_ONCE) characters each; a longer text is a range of its own."""
    start, n = 0, 0
    most = most or CHARS_AT_ONCE
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield start, i
            start, n = i, 0
        n += len(t)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in order, with a line feed after each text, and the start of each text."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return cp, np.concatenate(([0], ends[:-1]))


def sizes(texts: list[str | None]) -> np.ndarray:
    """Tokens of each text as the BERT basic tokenizer splits it; 0 for null and empty texts."""
    table = classes()
    clean = [t or "" for t in texts]
    out = np.zeros(len(clean), dtype=np.int64)
    for a, b in chunks(clean):
        cp, starts = code_points(clean[a:b])
        k = table[cp]
        own = np.repeat(np.arange(b - a), np.diff(np.append(starts, len(cp))))
        keep = k != CTRL  # invisible characters neither count nor divide a run
        k, own = k[keep], own[keep]
        single = (k == HAN) | (k == PUNCT)
        run = ~single & (k != BLANK)
        begins = run.copy()
        begins[1:] &= ~run[:-1]  # the line feed after each text ends its last run
        out[a:b] = np.bincount(own[single | begins], minlength=b - a)
    return out
