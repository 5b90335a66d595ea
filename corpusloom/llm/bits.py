"""Summaries of fixed size that Python workers build over all rows and then look up.

`Bitmap`: a set of hashes that may hold too much, never too little; `Sketch`: how often each hash came, never less.
Their size is a parameter, bounded by MOST_BITS where it follows the data, so they may be broadcast: 2**bits / 8 bytes and
2**bits * 2 bytes. Beyond the bound `marked` and `only_members` join instead. They only save work or choose between ways
that are all right; no result hangs on them.
Partial ones are merged in parts of PART cells by as many tasks as there are parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import mixed

#: A bitmap that is broadcast has at most 2**MOST_BITS bits (32 MB) and at least LEAST_PER bits for each hash.
MOST_BITS, LEAST_PER = 28, 8
#: Hashes that are gathered before they are counted.
HELD = 1 << 21
PART = 1 << 16
_SCHEMA = "part int, kind int, cells binary"


def _probes(bits: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each hash."""
    return hashes >> np.uint64(64 - bits), (hashes * np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - bits)


def bitmap_add(cells: np.ndarray, bits: int, hashes: np.ndarray) -> None:
    for i in _probes(bits, hashes):
        byte, bit = (i >> np.uint64(3)).astype(np.int64), (i & np.uint64(7)).astype(np.uint8)
        for v in range(8):  # of one bit, so that a byte named twice is set right
            cells[byte[bit == v]] |= np.uint8(1 << v)


def bitmap_has(cells: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    def probe(h: np.ndarray) -> np.ndarray:
        i = h >> np.uint64(64 - bits)
        return (cells[(i >> np.uint64(3)).astype(np.int64)] >> (i & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

    has = probe(hashes)
    left = np.flatnonzero(has)
    has[left] = probe(hashes[left] * np.uint64(0xA24BAED4963EE407))  # the second bit only of those that have the first
    return has


def bits_for(n: int, most: int) -> int:
    """Bits of a bitmap for so many hashes, 16 for each, within bounds."""
    return min(most, max(16, (16 * n).bit_length()))


def sketch_add(cells: np.ndarray, bits: int, hashes: np.ndarray) -> None:
    if len(hashes) > len(cells) // 8:
        n = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=len(cells))
        np.minimum(cells + n, 65535, out=cells, casting="unsafe")
        return
    i, n = np.unique(hashes >> np.uint64(64 - bits), return_counts=True)
    i = i.astype(np.int64)
    cells[i] = np.minimum(cells[i].astype(np.int64) + n, 65535).astype(np.uint16)


def sketch_get(cells: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    return cells[(hashes >> np.uint64(64 - bits)).astype(np.int64)]


def empty(kind: str, bits: int) -> np.ndarray:
    return np.zeros(1 << (bits - 3), np.uint8) if kind == "bitmap" else np.zeros(1 << bits, np.uint16)


def gather(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], *, bitmap: int = 0, sketch: int = 0) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The bitmap and the sketch (of so many bits; 0: none) of the hashes that the function gives of each batch of df."""
    sizes = [("bitmap", bitmap), ("sketch", sketch)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [empty(k, b) if b else None for k, b in sizes]
        seen, held, size = False, [], 0

        def add() -> None:
            h = np.concatenate(held)
            if own[0] is not None:
                bitmap_add(own[0], bitmap, h)
            if own[1] is not None:
                sketch_add(own[1], sketch, h)

        for batch in batches:
            h = hashes(batch)
            if not len(h):
                continue
            seen = True
            held.append(h)
            size += len(h)
            if size >= HELD:
                add()
                held, size = [], 0
        if not seen:
            return
        if held:
            add()
        for kind, cells in enumerate(own):
            if cells is not None:
                for at in range(0, len(cells), PART):
                    piece = cells[at : at + PART]
                    if piece.any():
                        yield pa.RecordBatch.from_arrays([pa.array([at // PART], pa.int32()), pa.array([kind], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], ["part", "kind", "cells"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, dtype = None, np.uint8 if key[1].as_py() == 0 else np.uint16
        for batch in batches:
            for raw in batch.column("cells").to_pylist():
                piece = np.frombuffer(zlib.decompress(raw), dtype)
                if total is None:
                    total = piece.astype(np.int64) if dtype is np.uint16 else piece.copy()
                else:
                    total = total + piece if dtype is np.uint16 else total | piece
        out = np.minimum(total, np.iinfo(dtype).max).astype(dtype)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], ["part", "kind", "cells"])

    made = [empty(k, b) if b else None for k, b in sizes]
    parts = df.mapInArrow(build, _SCHEMA).groupBy("part", "kind").applyInArrow(merge, _SCHEMA)
    for row in parts.collect():  # bounded: the size of the two summaries
        cells = made[row["kind"]]
        piece = np.frombuffer(zlib.decompress(bytes(row["cells"])), cells.dtype)
        cells[row["part"] * PART : row["part"] * PART + len(piece)] = piece
    return made[0], made[1]


def bits_of(n: int, most: int = MOST_BITS) -> int | None:
    """Bits of a bitmap for so many hashes, up to 16 for each; None if it can't hold them within the bound."""
    bits = bits_for(n, most)
    return bits if LEAST_PER * n <= 1 << bits else None


def _hash(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return mixed(batch.column(column).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def marked(rows: DataFrame, column: str, wanted: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """rows with `marked`: whether the bigint in `column` may be among those of `wanted` (distinct); true for all that are.

    By a bitmap of the size that their number asks for; beyond its bound, by a join.
    """
    bits = bits_of(wanted.count(), most)
    if bits is None:
        return rows.join(wanted.select(column, F.lit(True).alias("_there")), column, "left").withColumn("marked", F.coalesce("_there", F.lit(False))).drop("_there")
    cells = rows.sparkSession.sparkContext.broadcast(gather(wanted.select(column), lambda b: _hash(b, column), bitmap=bits)[0])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("marked", pa.array(bitmap_has(cells.value, bits, _hash(batch, column))))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(mark, f"{fields}, marked boolean")


def only_members(rows: DataFrame, column: str, wanted: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """The rows whose bigint in `column` is among those of `wanted` (distinct), and maybe a few others."""
    bits = bits_of(wanted.count(), most)
    if bits is None:
        return rows.join(wanted.select(column), column, "left_semi")
    cells = rows.sparkSession.sparkContext.broadcast(gather(wanted.select(column), lambda b: _hash(b, column), bitmap=bits)[0])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap_has(cells.value, bits, _hash(batch, column))))

    return rows.mapInArrow(keep, rows.schema)
