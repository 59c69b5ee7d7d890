"""The splitting of texts into words that byte-level BPE vocabularies of the 50k kind expect, on whole arrays at once.

The rule is the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Runs of letters, numbers, white
space and anything else are found from one class for each code point; then the few context rules of the pattern move the borders.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The code points of Unicode's White_Space.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_CLASS: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point."""
    global _CLASS
    if _CLASS is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[list(WHITE)] = SPACE
        _CLASS = table
    return _CLASS


def word_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin in ``points``, the code points of texts one after the other; ``ends`` are the ends of the texts.

    Every code point belongs to exactly one word, and no word crosses the end of a text.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)  # the first code point of a text
    first[0] = True
    first[ends] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    blank = points == 32
    at = np.flatnonzero(run[1:] & ~first[1:n]) + 1  # runs that follow another of the same text
    after_space = at[kind[at - 1] == SPACE]
    # white space before a word: its last character goes with the word if it is a blank, else it is a word by itself
    start[after_space - 1] = True
    start[after_space[blank[after_space - 1]]] = False
    # contractions: an apostrophe alone, not led by a blank, before certain letters
    quote = np.flatnonzero(run & (points == 39) & (kind == OTHER))
    quote = quote[start[quote]]
    if len(quote):
        one = np.append(points, np.zeros(3, points.dtype))
        inside = np.append(~first[:n], np.zeros(3, bool))  # continues the text
        a, b = one[quote + 1], one[quote + 2]
        in1, in2 = inside[quote + 1], inside[quote + 2]
        short = in1 & np.isin(a, [ord(c) for c in "stmd"])
        long = in1 & in2 & ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for which, size in ((short, 2), (long, 3)):
            q = quote[which]
            start[q + 1] = False
            q = q + size
            q = q[q < n]
            start[q[~first[q] & (kind[q] == LETTER)]] = True
    return np.flatnonzero(start)


def byte_widths(points: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes of each code point."""
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word offsets, first word of each text and one more) of texts in UTF-8 one after the other; invalid bytes become U+FFFD."""
    if bool((data < 128).all()):
        points, at = data, offsets
        starts = word_starts(points.astype(np.uint32), offsets[1:])
        borders = np.append(starts, len(data))
    else:
        text = data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(byte_widths(points), out=place[1:])
        if place[-1] != len(data):
            parts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return words(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
        at = np.searchsorted(place, offsets)
        borders = np.append(place[word_starts(points, at[1:])], len(data))
    return data, borders, np.searchsorted(borders[:-1], offsets)
