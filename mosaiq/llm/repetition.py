"""Repetition inside single documents, by compression bands.

Each text is reduced to its lower-case letters (what case, digits, spaces and punctuation say doesn't count). zstandard then compresses two renderings of
them, as a whole and in fixed chunks: the letters themselves, and their *windows*, one byte hashed from every few letters in a row. Hashed bytes have no
statistics to gain from and words in common are too short to match in them, so what the windows lose is what the text says again, in any alphabet.
Ratios are held against limits that depend on the length: windows below the lower limit make a text *repetitive*, letters above the upper one
*incompressible*. The exact share, of letters in stretches of at least ``WINDOW`` bytes that stood before, is measured for what the bands don't reject.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.arrow_text import text_slices

#: A repeated stretch has at least so many bytes of letters (about five words); shorter texts take a quarter of their length.
WINDOW = 24
#: Bytes of letters in a chunk.
CHUNK = 2048
#: Least length in bytes of letters, letters hashed into a byte of the windows, and the ratios below which windows are repetitive and above which letters are
#: incompressible. A text three tenths of which are scattered phrases of ``WINDOW`` letters, the least that counts, stays below the lower limit.
BANDS = ((64, 4, 0.90, 1.20), (80, 4, 0.85, 1.05), (96, 4, 0.83, 1.00), (200, 8, 0.84, 0.95), (400, 8, 0.84, 0.90), (800, 8, 0.84, 0.85), (1600, 8, 0.835, 0.80), (3200, 8, 0.83, 0.75), (6400, 8, 0.825, 0.70))
#: Chunks stand for themselves; a text of which this share lies in repetitive chunks is repetitive.
CHUNK_SHARE = 0.3
#: Bytes of windows up to which the usual compressor looks back over all of a text.
SEEN = 1 << 21

_LETTER: np.ndarray | None = None


def letters(text: str) -> bytes:
    """The letters of ``text`` in lower case, as UTF-8."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    if text.isascii():
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        return raw[(raw >= 97) & (raw <= 122)].tobytes()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return points[_LETTER[points] & ((points < 0xD800) | (points > 0xDFFF))].tobytes().decode("utf-32-le").encode()


def limits(size: int) -> tuple[int, float, float] | None:
    """(letters in a window, lower ratio, upper ratio) for ``size`` bytes of letters; None where a block of zstandard costs more than it can gain."""
    return next(((k, low, high) for least, k, low, high in reversed(BANDS) if size >= least), None)


def window_hashes(raw: bytes, k: int) -> np.ndarray:
    """A polynomial hash of every ``k`` bytes in a row of ``raw``, which has at least so many, by doubling: h[2m] of i is h[m] of i times b^m plus h[m] of i + m."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    h, m = a * np.uint64(0xFF51AFD7ED558CCD), 1
    total, done, power = None, 0, np.full(1, 0x9E3779B97F4A7C15, np.uint64)  # an array, as scalars warn when they overflow
    bits = k
    while bits:
        if bits & 1:
            if total is None:
                total, done = h, m
            else:
                size = len(a) - done - m + 1
                total = total[:size] * power + h[done : done + size]
                done += m
        bits >>= 1
        if bits:
            h = h[: len(h) - m] * power + h[m:]
            power = power * power
            m *= 2
    return total


def windows(raw: bytes, k: int) -> bytes:
    """One byte for every ``k`` letters in a row."""
    h = window_hashes(raw, k)
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(56)).astype(np.uint8).tobytes()


def repeated_share(raw: bytes, window: int = WINDOW) -> float:
    """The share of ``raw`` that lies in stretches of ``window`` bytes which began earlier in it too.

    Stretches may overlap what they repeat. Below four windows the window is a quarter of the length, at least 3 bytes.
    """
    n = len(raw)
    k = min(window, max(3, n // 4))
    if n <= k:
        return 0.0
    total = window_hashes(raw, k)
    order = np.argsort(total, kind="stable")
    ordered = total[order]
    again = order[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0.0
    cover = np.zeros(n + 1, np.int32)
    cover[again] += 1
    np.subtract.at(cover, again + k, 1)
    return float(np.count_nonzero(np.cumsum(cover[:-1]) > 0)) / n


class Bands:
    """The compressors of a task and what they say about texts."""

    def __init__(self) -> None:
        self.letters = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.windows = zstandard.ZstdCompressor(level=12, write_content_size=False, write_checksum=False)
        self.frame = len(self.letters.compress(b""))

    def ratio(self, compressor: zstandard.ZstdCompressor, part: bytes) -> float:
        """What is left of ``part``, the frame itself not counted."""
        return (len(compressor.compress(part)) - self.frame) / len(part)

    def novelty(self, raw: bytes, k: int) -> float:
        part = windows(raw, k)
        if len(part) <= SEEN:
            return self.ratio(self.windows, part)
        bits = min(31, len(part).bit_length())
        wide = zstandard.ZstdCompressionParameters.from_level(12, window_log=bits, enable_ldm=True, ldm_hash_log=min(26, bits), ldm_min_match=32, write_content_size=False)
        return self.ratio(zstandard.ZstdCompressor(compression_params=wide), part)

    def measure(self, text: str | None, exact: bool = True) -> tuple[int, float | None, float | None, float | None, str, float | None]:
        """(bytes of letters, ratio of letters, ratio of windows, share in repetitive chunks, band, repeated share) of a text; null is like empty.

        Without ``exact`` the share is measured only where the band doesn't rule repetition out, and null elsewhere.
        """
        raw = letters(text) if text else b""
        n = len(raw)
        if not n:
            return 0, None, None, None, "empty", 0.0
        ratio, limit = self.ratio(self.letters, raw), limits(n)
        if limit is None:
            return n, ratio, None, None, "short", repeated_share(raw)
        k, low, high = limit
        novelty, inside = self.novelty(raw, k), 0
        if n > CHUNK:
            for at in range(0, n, CHUNK):
                part = raw[at : at + CHUNK]
                own = limits(len(part))
                if own and self.novelty(part, own[0]) < own[1]:
                    inside += len(part)
        share = inside / n if n > CHUNK else float(novelty < low)
        band = "repetitive" if novelty < low or share >= CHUNK_SHARE else "incompressible" if ratio > high else "normal"
        return n, ratio, novelty, share, band, repeated_share(raw) if exact or band == "repetitive" else None


def repetition(documents: DataFrame, key: str = "doc_id", text: str = "text", exact: bool = True) -> DataFrame:
    """(key, n_letters, ratio, novelty, chunk_share, band, repeated_share): one row for each row of ``documents``.

    ``ratio`` is that of the letters, ``novelty`` that of their windows. Null, empty and letterless texts have band ``empty``, share 0 and no ratios; texts too short for a
    compressor have band ``short`` and the exact share alone. Every row, copies too, is measured by itself; no row needs another, so nothing is shuffled. Other columns
    are not looked at. Without ``exact`` the share is null for ``normal`` and ``incompressible`` texts.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in batches:
            out = []
            for _, _, data, offsets in text_slices(batch.column(1)):
                blob = data.tobytes()
                out += [bands.measure(blob[a:b].decode("utf-8", "replace"), exact) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            n, ratio, novelty, share, band, repeated = zip(*out) if out else ((), (), (), (), (), ())
            real = lambda x: pa.array(x, pa.float64())
            columns = [batch.column(0), pa.array(n, pa.int64()), real(ratio), real(novelty), real(share), pa.array(band, pa.string()), real(repeated)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_letters", "ratio", "novelty", "chunk_share", "band", "repeated_share"])

    schema = f"`{key}` {kind}, n_letters bigint, ratio double, novelty double, chunk_share double, band string, repeated_share double"
    return documents.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def repetitive(documents: DataFrame, least: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of the documents that the bands call repetitive and whose exact share is at least ``least``; among ``short`` ones the share alone decides.

    The bands are laid out for a share of three tenths and more: a smaller ``least`` finds what they let through.
    """
    rows = repetition(documents, key, text, exact=False)
    return rows.where(F.col("band").isin("repetitive", "short") & (F.col("repeated_share") >= least)).select(key)
