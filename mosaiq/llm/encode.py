"""Encoding a whole corpus with a public byte-level BPE vocabulary.

One pass counts all words of the corpus; the most frequent ones, a bounded number, are merged once and compiled into the
lexicon of :mod:`mosaiq.llm.lexicon`, which goes to the folder all executors share. A second pass walks every word through the lexicon and merges
the rest exactly, so the ids never depend on which words the lexicon holds.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.arrow_text import text_slices
from mosaiq.llm.lexicon import Lexicon, merge, read_ranks
from mosaiq.llm.pretokenize import words
from mosaiq.runtime import is_mounted, local_path, shared_dir, written

#: Words compiled into the lexicon at most; longer ones than this many bytes are left to merging.
LEXICON_WORDS, LEXICON_BYTES = 60_000, 48
#: Words that a worker keeps with their ids besides the lexicon.
CACHED = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary file lies: in ``$TOKENIZER_DIR``, else with the installed package, else in /opt/tokenizers."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    return read_ranks(path)


@lru_cache(maxsize=4)
def _lexicon(folder: str) -> Lexicon:
    return Lexicon.load(SparkFiles.get(folder.removeprefix("spark-files:")) if folder.startswith("spark-files:") else folder)


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, n): how often each word of at most ``LEXICON_BYTES`` bytes occurs in all texts.

    Words are counted in each batch before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[bytes, int] = {}
            for _, _, data, offsets in text_slices(batch.column(0)):
                raw, borders, _ = words(data, offsets)
                if len(borders) < 2:
                    continue
                size = np.diff(borders)
                keep = np.flatnonzero(size <= LEXICON_BYTES)
                hashed = _hashes_of(raw, borders, keep)
                _, where, n = np.unique(hashed, return_index=True, return_counts=True)
                blob = raw.tobytes()
                for i, k in zip(keep[where].tolist(), n.tolist()):
                    w = blob[borders[i] : borders[i + 1]]
                    total[w] = total.get(w, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = documents.select(F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull()).mapInArrow(run, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _hashes_of(data: np.ndarray, borders: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of ``keep``, all words in step."""
    out = np.full(len(keep), 0xCBF29CE484222325, np.uint64)
    index = np.arange(len(keep))
    at, end = borders[keep].copy(), borders[keep + 1]
    while len(index):
        out[index] = (out[index] ^ data[at].astype(np.uint64)) * np.uint64(0x100000001B3)
        at += 1
        go = at < end
        index, at, end = index[go], at[go], end[go]
    return out ^ (out >> np.uint64(29))


def build_lexicon(documents: DataFrame, vocabulary: str, text: str = "text", most: int = LEXICON_WORDS) -> str:
    """The folder of a lexicon of the ``most`` most frequent words of the corpus (at most so many rows come to the driver)."""
    top = word_counts(documents, text).orderBy(F.desc("n"), F.asc("word")).limit(most).select("word").toArrow()
    ranks = _ranks(vocabulary)
    entries = {w: merge(w, ranks) for w in (bytes(x) for x in top.column(0).to_pylist())}
    name, shared = f"lexicon-{uuid.uuid4().hex}", shared_dir(documents.sparkSession)
    lexicon = Lexicon.compile(entries)
    if not is_mounted(documents.sparkSession, shared):  # Spark hands the files to every executor
        with tempfile.TemporaryDirectory() as tmp:
            lexicon.save(f"{tmp}/{name}")
            documents.sparkSession.sparkContext.addFile(f"{tmp}/{name}", recursive=True)
        return f"spark-files:{name}"
    written(f"{shared}/{name}")
    lexicon.save(f"{local_path(shared)}/{name}")
    return f"{local_path(shared)}/{name}"


class Encoder:
    """Encodes slices of texts with a lexicon and exact merging."""

    def __init__(self, folder: str, vocabulary: str):
        self.lexicon = _lexicon(folder)
        self.ranks = _ranks(vocabulary)
        self.cache: dict[bytes, np.ndarray] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        raw, borders, first = words(data, offsets)
        number = self.lexicon.numbers(raw, borders)
        known = number >= 0
        start = np.asarray(self.lexicon.start)
        size = np.zeros(len(number), np.int64)
        size[known] = start[number[known] + 1] - start[number[known]]
        unseen = np.flatnonzero(~known)
        found = []
        if len(unseen):
            blob = raw.tobytes()
            for a, b in zip(borders[unseen].tolist(), borders[unseen + 1].tolist()):
                w = blob[a:b]
                ids = self.cache.get(w)
                if ids is None:
                    ids = np.array(merge(w, self.ranks), np.int32)
                    if len(self.cache) >= CACHED:
                        self.cache.clear()
                    if len(w) <= 256:
                        self.cache[w] = ids
                found.append(ids)
            size[unseen] = [len(x) for x in found]
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        out = np.zeros(int(ends[-1]), np.int32)
        k = np.flatnonzero(known)
        span = size[k]
        shift = np.repeat(start[number[k]] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        place = np.repeat(ends[:-1][k] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        out[place] = np.asarray(self.lexicon.ids)[shift]
        for w, ids in zip(unseen.tolist(), found):
            out[ends[w] : ends[w + 1]] = ids
        return out, np.diff(ends[first])


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, lexicon: str | None = None, ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ids array<int>), or (key, n_tokens bigint) without ``ids``: one row for each row of ``documents``.

    Null and empty texts give an empty list (0 tokens). Strings that look like special tokens are ordinary text. Repeated rows and copies are encoded each;
    of the other columns those of ``keep`` come along, the rest is not looked at. ``vocabulary`` is the path of the public ranks file, ``lexicon`` the folder of a lexicon built before.
    """
    vocabulary = vocabulary or vocabulary_path()
    folder = lexicon or build_lexicon(documents, vocabulary, text)
    along = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(folder, vocabulary)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(len(along))):
                out, n = encoder.encode(data, offsets)
                if ids:
                    ends = np.zeros(len(n) + 1, np.int32)
                    np.cumsum(n, out=ends[1:])
                    column = pa.ListArray.from_arrays(pa.array(ends), pa.array(out))
                else:
                    column = pa.array(n, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(along))], column], names=[*along, "ids" if ids else "n_tokens"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in along) + (", ids array<int>" if ids else ", n_tokens bigint")
    return documents.select(*along, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
