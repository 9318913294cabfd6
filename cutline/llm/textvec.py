"""Batches of texts as flat code-point arrays, cut into words, for numpy work inside tasks."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow.compute as pc

#: Scripts by code-point range (fixed values: Unicode blocks).
SCRIPTS = [
    ("latin", 0x41, 0x24F),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF),
    ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = list(dict.fromkeys(s for s, _, _ in SCRIPTS)) + ["other"]


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, whether it is part of a word: a letter, or a mark after one."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def scripts() -> np.ndarray:
    out = np.full(0x110000, len(SCRIPT_NAMES) - 1, np.uint8)
    for name, a, b in SCRIPTS:
        out[a : b + 1] = SCRIPT_NAMES.index(name)
    return out


class Words:
    """Words (runs of letters) of a batch of texts.

    cp: code points of all lower-cased texts, each after a blank; start, end: of each word in cp;
    doc: the text of each word; base: where each text begins in cp. Lower-casing is done only where
    it keeps the number of code points, so offsets are those of the text itself.
    """

    def __init__(self, texts: list[str]):
        low = []
        for t in texts:
            t = t or ""
            s = t.lower()
            if len(s) != len(t):
                s = "".join(y if len(y := c.lower()) == 1 else c for c in t)
            low.append(s)
        sizes = np.fromiter((len(s) for s in low), np.int64, len(low))
        self.cp = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.base = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(low) else np.zeros(0, np.int64)
        is_letter = letters()[self.cp]
        edge = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.base, self.start, side="right") - 1
        self.docs = len(low)

    def per_doc(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each text."""
        n = np.bincount(self.doc, minlength=self.docs)
        return np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n


def batches(texts_of, batch_iter, limit: int = 6_000_000):
    """Joins Arrow batches up to limit bytes of text and cuts longer ones there, so that vectors are long but bounded: each holds less than limit bytes before its last text."""
    held, last, done = [], 0, 0
    for b in batch_iter:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(texts_of(b)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        window = (done + np.cumsum(size) - size) // limit
        done += int(size.sum())
        for i, j in pairwise([0, *(np.flatnonzero(np.diff(window)) + 1).tolist(), b.num_rows]):
            if held and window[i] != last:
                yield held
                held = []
            held.append(b.slice(i, j - i))
            last = window[i]
    if held:
        yield held


def lanes(first: np.ndarray, count: np.ndarray):
    """Order of texts by falling length, and for each step how many still have a word there."""
    order = np.argsort(-count, kind="stable")
    sorted_n = count[order]
    longest = int(sorted_n[0]) if len(sorted_n) else 0
    active = np.searchsorted(-sorted_n, -np.arange(longest), side="left")
    return order, first[order], active


SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-shift rounds)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
        return x
