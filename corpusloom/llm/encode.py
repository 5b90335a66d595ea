"""Encoding of a corpus with a public byte-level BPE tokenizer, by a pair occurrence index.

A partition's texts are split into words by the tokenizer's pattern. Words not seen before in this worker are laid out
in one array of symbols with links to their neighbours. An index maps each adjacent pair that has a rank to all its
places; active ranks are taken in ascending order, all places of that pair are merged from left to right, and the lists
of the pairs around them are updated. Each distinct word is so encoded once, and texts are put together from the words.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import table

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the tokenizer's pattern for words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered by a worker; beyond that it starts afresh.
REMEMBERED = 1 << 19


class PairIndexEncoder:
    """The ids of words by a rank file; the same ids as the public tokenizer gives without special tokens."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        self.split = regex.compile(PATTERN).findall
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.token = {r: t for t, r in self.ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], int] = {}

    def _rank(self, a: int, b: int) -> int:
        """The rank of the pair, -1 if it has none."""
        r = self._pairs.get((a, b))
        if r is None:
            r = self._pairs[a, b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return r

    def learn(self, new: list[str]) -> None:
        """Encodes all words of the list at once."""
        sym: list[int] = []
        start: list[int] = []
        for w in new:
            start.append(len(sym))
            sym.extend(map(self.single.__getitem__, w.encode("utf-8", "replace")))
            sym.append(-1)  # no pair reaches over it
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        places: dict[tuple[int, int], list[int]] = {}
        active: list[tuple[int, tuple[int, int]]] = []
        rank = self._rank

        def note(a: int, b: int, at: int) -> None:
            if a >= 0 and b >= 0 and (r := rank(a, b)) >= 0:
                held = places.get((a, b))
                if held is None:
                    places[a, b] = [at]
                    heappush(active, (r, (a, b)))
                else:
                    held.append(at)

        for i in range(n - 1):
            note(sym[i], sym[i + 1], i)
        while active:
            merged, (a, b) = heappop(active)
            for i in sorted(places.pop((a, b))):
                if sym[i] != a or (j := right[i]) >= n or sym[j] != b:
                    continue  # a merge nearby has changed it
                k, h = right[j], left[i]
                sym[i], sym[j] = merged, -2
                right[i] = k
                if k < n:
                    left[k] = i
                    note(merged, sym[k], i)
                if h >= 0:
                    note(sym[h], merged, h)
        for w, at in zip(new, start, strict=True):
            out = []
            while sym[at] != -1:
                out.append(sym[at])
                at = right[at]
            self.known[w] = tuple(out)

    def encode(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """For each text the ids of its words, word by word; none for a null or empty text."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self._pairs.clear()
        new = list(dict.fromkeys(w for ws in split for w in set(ws) if w not in self.known))
        if new:
            self.learn(new)
        known = self.known.__getitem__
        return [list(map(known, ws)) for ws in split]


_encoders: dict[int, PairIndexEncoder] = {}


def encoder(file: Broadcast) -> PairIndexEncoder:
    """One encoder per worker and file."""
    known = zlib.crc32(file.value)
    if known not in _encoders:
        _encoders.clear()
        _encoders[known] = PairIndexEncoder(file.value)
    return _encoders[known]


def vocabulary_file(spark: SparkSession, folder: str, vocabulary: str) -> Broadcast:
    """The file (under a megabyte) as the driver reads it, sent to the executors: they need no copy of the folder."""
    with open(os.path.join(folder, vocabulary), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """id_col and ids (array<int>) of every row of docs, without special tokens; their strings in a text are ordinary text.

    A null and an empty text both give an empty list. A null id is kept; rows that repeat come out as often as they came;
    texts of any length are encoded whole; further columns are not read.
    """
    file = vocabulary_file(docs.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for part in _chunks(batches):
            words = enc.encode(part.column(1).to_pylist())
            flat = np.fromiter(chain.from_iterable(chain.from_iterable(words)), np.int32)
            ends = np.cumsum([0] + [sum(map(len, ws)) for ws in words])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, text_col: str = "text", *, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with its text replaced by n_tokens, the number of its ids; 0 for a null or empty text."""
    file = vocabulary_file(docs.sparkSession, folder, vocabulary)
    docs = docs.select([c for c in docs.columns if c != "n_tokens"])
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for part in _chunks(batches):
            n = [sum(map(len, ws)) for ws in enc.encode(part.column(text_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return docs.mapInArrow(run, f"{fields}, n_tokens bigint")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, documents without tokens, and tokens."""
    docs = table(spark, sf_dir, "documents").select(F.lower(F.trim("source")).alias("source"), "text")
    n = token_counts(docs)
    return n.groupBy("source").agg(F.count("*").alias("n_docs"), F.count(F.when(F.col("n_tokens") == 0, 1)).alias("n_empty"), F.sum("n_tokens").alias("n_tokens"))


QUERIES = {"p6_ids": p6_ids, "p6_report": p6_report}
SQL: dict[str, str] = {}
