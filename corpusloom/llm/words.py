"""Texts as words in one normal form, in Python workers: what several operators compare, count and hash.

`words(text)`: mark-up, case, punctuation, invisible characters, accents and look-alike letters are folded away; the
rest is split at white space. `Hashes` gives each word its CRC-32, with a cache for the words seen in this worker.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib

import numpy as np

#: Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
        "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ɡ": "g", "ı": "i",
        "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
        "І": "I", "Ј": "J", "Ѕ": "S",
        "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "ι": "i", "κ": "k", "υ": "u", "χ": "x",
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    }
)
TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]{0,200}>|<[/!?]?[A-Za-z]>|<!--.*?-->", re.S)
#: Combining marks, format characters (soft hyphen, zero width), variation selectors.
INVISIBLE = re.compile("[­̀-ͯ͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
NO_WORD = re.compile(r"[^\w\s]|_")
_LOWER = bytes(ord(" ") if i < 33 else ord(chr(i).lower()) if i < 128 else i for i in range(256))
_DROP = bytes(i for i in range(33, 127) if not chr(i).isalnum()) + b"\x7f"
_DASHES = str.maketrans(dict.fromkeys("–—―…/|", " "))


def plain(text: str) -> str:
    """The text without mark-up, invisible characters, accents and look-alikes; case and punctuation stay."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKD", text)).translate(LOOK_ALIKES)
    return text


def words(text: str | None) -> list[bytes]:
    """The words in normal form; none for a null, empty or blank text."""
    if not text:
        return []
    text = plain(text)
    if not text.isascii():
        text = NO_WORD.sub("", text.translate(_DASHES).lower())
        return text.encode("utf-8", "replace").split()
    return text.encode().translate(_LOWER, _DROP).split()


class Hashes(dict):
    """word -> CRC-32, remembered up to a bound."""

    BOUND = 1 << 20

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        v = self[word] = zlib.crc32(word)
        return v

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint32, len(ws))


_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A second scramble of 64-bit hashes, so that any of their bits can be used."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(ws: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all runs of q words."""
    n = len(ws) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    x = ws.astype(np.uint64) + np.uint64(1)
    for i in range(q):
        h = (h + x[i : n + i]) * _M
        h ^= h >> np.uint64(29)
    return mixed(h)


def common_in_order(a: list, b: list, band: int | None = None) -> int:
    """How many items a and b share in order (longest common subsequence), bit-parallel dynamic programming.

    With a band, only cells at most so far off the diagonal count; that is exact where len(a) and len(b) less the
    result are at most the band.
    """
    i = 0
    end = min(len(a), len(b))
    while i < end and a[i] == b[i]:
        i += 1
    j = 0
    while j < end - i and a[-1 - j] == b[-1 - j]:
        j += 1
    same = i + j
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return same
    at: dict = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << k)
    full = (1 << len(a)) - 1
    v = full
    get = at.get
    if band is None:
        for w in b:
            u = v & get(w, 0)
            v = ((v + u) | (v - u)) & full
    else:
        width = (1 << (2 * band + 1)) - 1
        for k, w in enumerate(b):
            m = get(w, 0)
            if m:
                m &= width << (k - band) if k >= band else width >> (band - k)
            u = v & m
            v = ((v + u) | (v - u)) & full
    return same + len(a) - v.bit_count()
