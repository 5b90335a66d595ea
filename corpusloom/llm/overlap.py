"""Same or nearly the same records across splits: a covering join over bags of words.

Two records overlap if their texts are the same in normal form, or if the longest common subsequence L of their words
(n and m of them) is at least nine tenths of the longer. Then n + m - 2L words of both have no partner, at most a fifth of
either's words and fewer if the lengths differ: d. The words that exist are dealt into parts, more than d / (R + 1) of them,
so in one part at least the two texts differ in R words at most. In a part each word stands in one of 2**(R+1) - 1 cells, the
nonzero vectors of R + 1 bits; for each such vector v a text has a signature, a hash of the bag of its words in cells x
with an odd <v, x>. R cells leave a v that is orthogonal to all of them: its signature, of about half the words of the
part, is the same in both texts. So the join loses no pair, wherever words were changed. An evaluation text has signatures
only of as many parts as its length asks for, those where it has most cells. Frequent words are dealt in turn, so that all
cells tell as much; how they are dealt is free as long as it is the same for all texts.

A signature takes words from all over a text. That matters in corpora made of recurring phrases, where any run of a few
words stands in a fixed share of all texts and a join by such runs grows with the square of the table: at 0.1 GB it
looked at 753 million pairs of places, this one at 3.6 million pairs of texts.

Nothing that grows with the data is broadcast. All signatures of training texts go through the shuffle, packed: of each
length class and some of its columns (signatures) a bucket, bounded by the evaluation texts it holds; what a text needs once
stands once in a bucket. Buckets are matched by sorted search. Lengths are checked there, and for each text 256 bits that say which
slots hold an odd number of its words: a word without a partner turns over one bit, and a pair may have n + m - 2L such
words. Only pairs of texts come back. What is left is verified by banded dynamic programming over the whole texts.

Copies: pairs are between distinct texts (by the fingerprint `wfp` of their words), and of a text that came more than
COPIES times on a side one row is joined; ids come back at the end. `fp`, the fingerprint without the spaces,
finds texts that differ in spacing only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.keys import key, split_name, stripped, text_records
from corpusloom.llm.bits import marked, only_members
from corpusloom.llm.words import Hashes, common_in_order, mixed, words
from corpusloom.session import written

MIN_WORDS = 50
Q = 4
#: Words in which texts may differ in the part that finds them; signatures of a part.
R = 3
SIGNATURES = (2 << R) - 1
#: Lengths of two texts that may overlap (a factor of 10/9 at most) lie in the same class of this ratio or in neighbours.
RATIO = 10 / 9
#: Words that are dealt by frequency, the others by hash.
DEALT = 1 << 16
#: Copies of a text on one side that are joined as they are; of more, one row is.
COPIES = 8
#: Signatures a worker holds before it sends blocks; evaluation signatures of a bucket, and buckets there are about, at least.
HELD, BUCKET, BUCKETS = 8_000_000, 24_000_000, 48
#: Training texts matched at a time, and pairs of signatures looked at at a time.
TEXTS, AT_ONCE = 50_000, 2_000_000
_TEXTS = "ref bigint, id string, at timestamp, side string, n int, fp bigint, wfp bigint, ws array<int>"


def max_apart(longer: np.ndarray | int) -> np.ndarray | int:
    """How many words of the longer of two texts may lack a partner."""
    return longer - (9 * longer + 9) // 10


def _arrays(col: pa.ListArray) -> list[np.ndarray]:
    flat = col.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    at = col.offsets.to_numpy()
    at = at - at[0]
    return [flat[at[i] : at[i + 1]] for i in range(len(col))]


def _fingerprint(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def _normalise(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        ref = TaskContext.get().partitionId() << 36
        for batch in batches:
            keep, n, fp, wfp, flat = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ws = words(text)
                if len(ws) >= min_words:
                    keep.append(i)
                    n.append(len(ws))
                    fp.append(_fingerprint(b"".join(ws)))
                    wfp.append(_fingerprint(b" ".join(ws)))
                    flat.append(hashes.of(ws))
            part = batch.take(pa.array(keep, pa.int64()))
            ends = np.cumsum([0, *n])
            ws_col = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).view(np.int32) if flat else [], pa.int32()))
            cols = [pa.array(np.arange(ref, ref + len(keep))), part.column("id"), part.column("at"), part.column("side"), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(wfp, pa.int64()), ws_col]
            yield pa.RecordBatch.from_arrays(cols, ["ref", "id", "at", "side", "n", "fp", "wfp", "ws"])
            ref += len(keep)

    return run


def normalised(records: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """ref (a number of the row), id, at, side (train or eval) and the words' hashes of each record with a split and enough words."""
    if min_words < 5 * Q:
        raise ValueError(f"texts of fewer than {5 * Q} words can't be cut into enough segments")
    side = F.when(F.col("split") == "train", "train").when(F.col("split").isin("val", "test"), "eval")
    rows = records.select("id", "at", "text", side.alias("side")).where("side is not null and id is not null and text is not null")
    return rows.mapInArrow(_normalise(min_words), _TEXTS)


def rarest(freq: np.ndarray, first: np.ndarray, ns: np.ndarray) -> list[np.ndarray]:
    """For each text, starts of n//5 + 1 disjoint segments of Q words of about the least total frequency.

    freq: frequencies of all grams, first: where each text's begin, ns: words of each text (of like length, at least
    5 * Q). Not called by the join any more. The text is tiled from its first to fourth word on; of the tiling whose rarest n//5 + 1 tiles are rarest
    in all, these are taken.
    """
    need = ns // 5 + 1
    most = int(ns.max()) // Q
    start = np.arange(Q)[:, None] + Q * np.arange(most)[None, :]  # (way, tile)
    there = start[None] + Q <= ns[:, None, None]
    f = np.where(there, freq[np.minimum(first[:, None, None] + start[None], len(freq) - 1)].astype(np.float64), np.inf)
    order = np.argsort(f, axis=2, kind="stable")
    total = np.cumsum(np.take_along_axis(f, order, 2), axis=2)
    row = np.arange(len(ns))
    way = total[row, :, need - 1].argmin(1)
    return [np.sort(start[w, order[i, w, : need[i]]]) for i, w in enumerate(way)]


def vocabulary(texts: DataFrame, most: int = DEALT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words (hashes, sorted) and the rank of each."""
    counts = texts.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    w = np.array([r["w"] for r in counts.orderBy(F.desc("c"), "w").limit(most).collect()], np.int32).view(np.uint32)
    order = np.argsort(w)
    return w[order], order


def _odd(part: pa.RecordBatch) -> np.ndarray:
    """Four 64-bit masks for each text: the slots that hold an odd number of its words."""
    col = part.column("ws")
    w = col.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    owner = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
    count = np.bincount(owner * 256 + (w >> np.uint32(24)), minlength=256 * len(col))
    return np.packbits((count & 1).astype(bool).reshape(-1, 256), axis=1).view(np.uint64)


def _class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(RATIO) + 1e-9).astype(np.int64)


def _first_length(c: int) -> int:
    """The smallest length of a class or a later one."""
    n = max(1, int(RATIO**c) - 1)
    while _class(np.array([n]))[0] < c:
        n += 1
    return n


def parts_of(c: int) -> int:
    """Parts into which the words are dealt for training texts of the class c."""
    return (_first_length(c + 1) - 1) // 5 // (R + 1) + 1


def parts_needed(n: np.ndarray, c: int) -> np.ndarray:
    """How many of the parts an evaluation text of n words must look up to find all overlapping texts of the class c; 0: there are none."""
    m = np.clip(n, _first_length(c), _first_length(c + 1) - 1)
    apart = (10 * (n + m) - 18 * np.maximum(n, m)) // 10
    return np.where(apart < 0, 0, apart // (R + 1) + 1)


def _classes_near(n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each class of training texts, with the numbers of the evaluation texts of n words that may overlap with some."""
    low, high = _class(-(-9 * n // 10)), _class(10 * n // 9)
    for c in range(int(low.min()), int(high.max()) + 1):
        yield c, np.flatnonzero((low <= c) & (c <= high))


def buckets_of(sizes: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
    """Of each class its first bucket, the columns of a bucket, and in how many ranges of hashes a bucket of one column is cut.

    sizes: training and evaluation texts of each class.
    """
    sizes = {c: (t, e) for c, (t, e) in sizes.items() if t and e}  # others have no pairs
    total = sum((t + e) * parts_of(c) * SIGNATURES for c, (t, e) in sizes.items())
    out, first = {}, 0
    for c, (t, e) in sorted(sizes.items()):
        columns = parts_of(c) * SIGNATURES
        most = min(BUCKET // e, max(1, total // BUCKETS) // (t + e))
        width = min(columns, most // SIGNATURES * SIGNATURES) if most >= SIGNATURES else next((w for w in (5, 3) if w <= most), 1)
        ranges = -(-e // BUCKET)
        out[c] = first, width, ranges
        first += -(-columns // width) * ranges
    return out


def _cells(w: np.ndarray, hashes: np.ndarray, vocab: np.ndarray, rank: np.ndarray):
    """A function that gives, of a number of cells, the cell of each word: frequent ones in turn, there and back."""
    at = np.minimum(np.searchsorted(vocab, w), max(0, len(vocab) - 1))
    known = vocab[at] == w if len(vocab) else np.zeros(len(w), bool)
    ranks = rank[at] if len(vocab) else np.zeros(len(w), np.int64)

    def of(chosen: np.ndarray, cells: int) -> np.ndarray:
        turn, cell = np.divmod(ranks[chosen], cells)
        cell = np.where(turn & 1, cells - 1 - cell, cell)
        return np.where(known[chosen], cell, ((hashes[chosen] >> np.uint64(32)) % np.uint64(cells)).astype(np.int64))

    return of


def signatures(owner: np.ndarray, hashes: np.ndarray, cell: np.ndarray, texts: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (text, part, vector) and how many cells of each part are in use (text, part).

    owner, hashes and cell (of parts * SIGNATURES): text, hash and cell of each word. A signature is the sum of the hashes in the
    cells with an odd product, by a Walsh-Hadamard transform: the difference of all and of signed sums is twice that.
    """
    size = SIGNATURES + 1
    sums = np.zeros(texts * parts * size, np.uint64)
    np.add.at(sums, (owner * parts + cell % parts) * size + cell // parts + 1, hashes)
    in_use = (sums.reshape(texts, parts, size) != 0).sum(axis=2)
    step = 1
    while step < size:
        pair = sums.reshape(-1, 2, step)
        sums = np.stack([pair[:, 0] + pair[:, 1], pair[:, 0] - pair[:, 1]], axis=1)
        step *= 2
    sums = sums.reshape(texts, parts, size)
    return (mixed(sums[:, :, :1] - sums[:, :, 1:]) >> np.uint64(32)).astype(np.uint32), in_use


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array, first all first bytes: what is alike stands together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(data: memoryview, dtype: type, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(dtype).reshape(n)


def pack(hashes: np.ndarray, doc: np.ndarray, pos: np.ndarray, ref: np.ndarray, ns: np.ndarray, bits: np.ndarray) -> bytes:
    """A block: 32-bit hashes, the text (an index into ref, ns and bits) and column of each."""
    parts = [np.array([len(hashes), len(ref), bits.shape[1]], np.int64).tobytes()]
    parts += [_planes(a) for a in (hashes.astype(np.uint32), doc.astype(np.uint32), pos.astype(np.uint32), np.diff(ref, prepend=0).astype(np.int64), ns.astype(np.uint32), *(b.copy() for b in bits.T))]
    return zstandard.ZstdCompressor(1).compress(b"".join(parts))


def unpack(block: bytes) -> tuple[np.ndarray, ...]:
    """Of a block hashes, doc and pos by place, ref, ns and bits by text."""
    data = memoryview(zstandard.ZstdDecompressor().decompress(block))
    n, texts, masks = np.frombuffer(data, np.int64, 3)
    at, out = 24, []
    for dtype, count in ((np.uint32, n), (np.uint32, n), (np.uint32, n), (np.int64, texts), (np.uint32, texts), *[(np.uint64, texts)] * masks):
        out.append(_from_planes(data[at:], dtype, count))
        at += np.dtype(dtype).itemsize * count
    hashes, doc, pos, ref, ns, *bits = out
    return hashes, doc.astype(np.int64), pos.astype(np.int32), np.cumsum(ref), ns.astype(np.int32), np.stack(bits, axis=1)


def _blocks(is_eval: bool, buckets: dict[int, tuple[int, int, int]], shared):
    """Blocks of the signatures of training or evaluation texts, by bucket: all columns of some texts, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, rank = shared.value
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def block(bucket: int, sig: np.ndarray, begin: int, rows: np.ndarray, of: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            n, columns = sig.shape
            packed = pack(sig.reshape(-1), np.repeat(np.arange(n), columns), np.tile(np.arange(begin, begin + columns), n), *(x[rows] for x in of))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([is_eval]), pa.array([packed], pa.binary())], ["bucket", "is_eval", "block"])

        def flush() -> Iterator[pa.RecordBatch]:
            for c, some in held.items():
                sig, use, *of = (np.concatenate(x) for x in zip(*some, strict=True))
                first, width, ranges = buckets[c]
                columns = sig.shape[1]
                step = min(width, SIGNATURES) if is_eval else width  # evaluation texts part by part: not all use the same
                for begin in range(0, columns, step):
                    own = slice(begin, min(begin + step, columns))
                    rows = np.flatnonzero(use[:, begin // SIGNATURES]) if is_eval else np.arange(len(sig))
                    bucket = first + begin // width * ranges
                    for r in range(ranges):
                        # a bucket of more ranges than one has one column
                        some_rows = rows if ranges == 1 else rows[(sig[rows, begin].astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32) == r]
                        if len(some_rows):
                            yield block(bucket + r, sig[some_rows, own], begin, some_rows, of)

        def add(c: int, chosen: np.ndarray, part: pa.RecordBatch, w: np.ndarray, ends: np.ndarray, cells, hashes: np.ndarray, ns: np.ndarray, bits: np.ndarray) -> int:
            need = parts_needed(ns[chosen], c) if is_eval else np.full(len(chosen), parts_of(c))
            chosen, need = chosen[need > 0], need[need > 0]
            if not len(chosen):
                return 0
            parts, lengths = parts_of(c), ns[chosen]
            owner = np.repeat(np.arange(len(chosen)), lengths)
            at = np.arange(len(owner)) + np.repeat(ends[chosen] - np.cumsum(lengths), lengths)
            sig, in_use = signatures(owner, hashes[at], cells(at, parts * SIGNATURES), len(chosen), parts)
            use = np.argsort(np.argsort(-in_use, axis=1, kind="stable"), axis=1) < need[:, None]
            held.setdefault(c, []).append((sig.reshape(len(chosen), -1), use, part.column("ref").to_numpy()[chosen], ns[chosen], bits[chosen]))
            return sig.size

        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                ns = part.column("n").to_numpy().astype(np.int64)
                w = part.column("ws").flatten().to_numpy(zero_copy_only=False).view(np.uint32)
                hashes = mixed((w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                cells, ends, bits = _cells(w, hashes, vocab, rank), np.cumsum(ns), _odd(part)
                own = _class(ns)
                near = _classes_near(ns) if is_eval else ((c, np.flatnonzero(own == c)) for c in np.unique(own).tolist())
                for c, chosen in near:
                    if c in buckets and len(chosen):
                        size += add(c, chosen, part, w, ends, cells, hashes, ns, bits)
                if size >= HELD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


class _Bucket:
    """The evaluation texts of a bucket, sorted by each of its columns."""

    def __init__(self, blocks: list[bytes]):
        texts, columns, before = [], {}, 0
        while blocks:
            h, _, column, *of = unpack(blocks.pop())
            n = len(of[0])
            sig = h.reshape(n, -1)
            for k, c in enumerate(column[: sig.shape[1]].tolist()):
                columns.setdefault(c, []).append((sig[:, k], np.arange(before, before + n, dtype=np.int32)))
            texts.append(of)
            before += n
        self.ref, self.n, self.bits = (np.concatenate(x) for x in zip(*texts, strict=True))
        self.sorted = {}
        for c in list(columns):
            h, at = (np.concatenate(x) for x in zip(*columns.pop(c), strict=True))
            order = np.argsort(h)
            self.sorted[c] = h[order], at[order]

    def pairs(self, blocks: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """The pairs with training texts, each once, that share a signature and may overlap by lengths and bits."""
        columns = blocks[0][2][: len(blocks[0][0]) // len(blocks[0][3])]
        sig = np.concatenate([x[0].reshape(-1, len(columns)) for x in blocks])
        tref, tn, tbits = (np.concatenate(x) for x in zip(*(x[3:] for x in blocks), strict=True))
        found, size = [np.empty(0, np.int64)], 0
        for k, column in enumerate(columns.tolist()):
            if column not in self.sorted:
                continue
            h, at = self.sorted[column]
            of = np.argsort(sig[:, k])
            th = sig[of, k]
            low = np.searchsorted(h, th)
            hit = np.flatnonzero(h[np.minimum(low, len(h) - 1)] == th)
            low = low[hit]
            count = np.searchsorted(h, th[hit], "right") - low
            done = np.cumsum(count)
            i = 0
            while i < len(hit):
                j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + AT_ONCE, "right")))
                c = count[i:j]
                e = at[np.repeat(low[i:j] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
                t = np.repeat(of[hit[i:j]], c)
                longer = np.maximum(self.n[e], tn[t])
                least = (9 * longer + 9) // 10
                ok = np.flatnonzero(np.minimum(self.n[e], tn[t]) >= least)
                e, t, least = e[ok], t[ok], least[ok]
                near = np.bitwise_count(self.bits[e] ^ tbits[t]).sum(axis=1) <= self.n[e] + tn[t] - 2 * least
                found.append(e[near].astype(np.int64) * len(tref) + t[near])
                size += len(found[-1])
                if size > AT_ONCE:  # texts that agree share many signatures
                    found = [np.unique(np.concatenate(found))]
                    size = 0
                i = j
        e, t = np.divmod(np.unique(np.concatenate(found)), len(tref))
        return pa.RecordBatch.from_arrays([pa.array(self.ref[e]), pa.array(tref[t])], ["ref_e", "ref_t"])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks sorted by bucket, evaluation first: the pairs (ref_e, ref_t) that may overlap."""
    now, ev, held, texts = -1, [], [], 0
    for batch in batches:
        for bucket, is_eval, block in zip(batch.column("bucket").to_pylist(), batch.column("is_eval").to_pylist(), batch.column("block"), strict=True):
            block = block.as_py()  # one at a time
            if bucket != now:
                if held:
                    yield ev.pairs(held)
                now, ev, held, texts = bucket, [], [], 0
            if is_eval:
                ev.append(block)
                continue
            if not ev:
                continue
            if isinstance(ev, list):
                ev = _Bucket(ev)
            held.append(unpack(block))
            texts += len(held[-1][3])
            if texts >= TEXTS:
                yield ev.pairs(held)
                held, texts = [], 0
    if held:
        yield ev.pairs(held)


def one_of_each(texts: DataFrame) -> DataFrame:
    """One row for each text of a side with more than COPIES copies; only rows of such texts are shuffled."""
    often = written(texts.groupBy("wfp", "side").agg(F.count("*").alias("c")).where(F.col("c") > COPIES).select("wfp").distinct(), "often")
    texts = texts.select("ref", "side", "n", "wfp", "ws")
    if often.isEmpty():
        return texts
    rows = marked(texts, "wfp", often)
    once = rows.where("marked").drop("marked").dropDuplicates(["side", "wfp"])  # rows that agree in these agree in n and ws
    return rows.where("not marked").drop("marked").unionByName(once)


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, count = batch.column("n").to_numpy().astype(np.int64), batch.column("c").to_numpy()
        ev = batch.column("side").to_numpy(zero_copy_only=False) == "eval"
        rows = [(c, 1, count[ev][i].sum()) for c, i in _classes_near(n[ev])] if ev.any() else []
        own = _class(n[~ev])
        rows += [(c, 0, count[~ev][own == c].sum()) for c in np.unique(own)]
        yield pa.RecordBatch.from_arrays([pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(3)], ["of_class", "is_eval", "texts"])


def candidate_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (ref_e, ref_t) of rows that share a signature and may overlap by lengths and bits."""
    spark = texts.sparkSession
    texts = one_of_each(texts)
    train, ev = texts.where("side = 'train'"), texts.where("side = 'eval'")
    # one number for each side and length class: texts of a million words have the 131st
    by_class = texts.groupBy("side", "n").agg(F.count("*").alias("c")).mapInArrow(_by_class, "of_class bigint, is_eval bigint, texts bigint").groupBy("of_class", "is_eval").agg(F.sum("texts").alias("texts")).collect()
    sizes: dict[int, list[int]] = {}
    for r in by_class:
        sizes.setdefault(r["of_class"], [0, 0])[r["is_eval"]] = r["texts"]
    buckets = buckets_of({c: (t, e) for c, (t, e) in sizes.items()})
    schema = "bucket int, is_eval boolean, block binary"
    shared = spark.sparkContext.broadcast(vocabulary(texts))
    blocks = [side.select("ref", "n", "ws").mapInArrow(_blocks(is_eval, buckets, shared), schema) for side, is_eval in ((train, False), (ev, True))]
    return blocks[0].unionByName(blocks[1]).repartition("bucket").sortWithinPartitions("bucket", F.desc("is_eval")).mapInArrow(_matched, "ref_e bigint, ref_t bigint").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(_arrays(batch.column("ws_e")), _arrays(batch.column("ws_t")), strict=True):
            a, b = a.tolist(), b.tolist()
            longer = max(len(a), len(b))
            apart, one, two = int(max_apart(longer)), set(a), set(b)
            # words that only one of them has can't have a partner
            near = len(one - two) <= apart and len(two - one) <= apart
            keep.append(near and 10 * common_in_order(a, b, apart + 1) >= 9 * longer)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["wfp_e", "wfp_t"])


def near_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (wfp_e, wfp_t) of texts, not the same but for spaces, that agree in nine tenths of their words in order."""
    found = written(candidate_pairs(texts), "pairs")
    ends = written(found.select(F.explode(F.array("ref_e", "ref_t")).alias("ref")).distinct(), "ends")
    some = written(only_members(texts.select("ref", "wfp", "fp", "ws"), "ref", ends), "ends")
    names = some.select("ref", "wfp", "fp")
    of = lambda side: names.select(*[F.col(c).alias(f"{c}_{side}") for c in ("ref", "wfp", "fp")])
    pairs = found.join(of("e"), "ref_e").join(of("t"), "ref_t").where("fp_e <> fp_t").select("wfp_e", "wfp_t").distinct()
    whole = some.select("wfp", "ws").dropDuplicates(["wfp"])
    both = pairs.join(whole.select(F.col("wfp").alias("wfp_e"), F.col("ws").alias("ws_e")), "wfp_e").join(whole.select(F.col("wfp").alias("wfp_t"), F.col("ws").alias("ws_t")), "wfp_t")
    return both.select("wfp_e", "wfp_t", "ws_e", "ws_t").mapInArrow(_verify, "wfp_e bigint, wfp_t bigint")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_records(spark, sf_dir, ["id", "text", "split", "source", "ingested_at"])
    return rows.select(stripped("id").alias("id"), "text", split_name("split").alias("split"), "source", F.col("ingested_at").alias("at"))


def _classes(recs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """ids: fp, wfp, id, k, side of each record that counts (the first arrival of its key); near: pairs (wfp_e, wfp_t)."""
    texts = written(normalised(recs, min_words), "texts")
    # min() skips nulls: a key with a time that is null and others counts by the others
    firsts = recs.select(key("id").alias("k"), "at").where("k is not null").groupBy("k").agg(F.min("at").alias("_at"))
    ids = texts.select("fp", "wfp", "id", key("id").alias("k"), "at", "side").join(firsts, "k")
    return ids.where(F.col("at").eqNullSafe(F.col("_at"))).select("fp", "wfp", "id", "k", "side"), near_pairs(texts)


def overlaps(recs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id_e, id_t, exact of each evaluation record and training record that overlap.

    recs: id, text, split (train, val, test or null) and at (time of arrival). A key that came more than once counts
    as it came first. Records with no split, another split, no id, no text or fewer than min_words words (20 at least)
    are in no pair; further columns of recs aren't read. Texts of any length are compared whole. An empty table gives no
    pairs.
    """
    ids, near = _classes(recs, min_words)
    of = lambda side, by: ids.where(F.col("side") == {"e": "eval", "t": "train"}[side]).select(F.col(by).alias(f"{by}_{side}"), F.col("id").alias(f"id_{side}"))
    same = of("e", "fp").join(of("t", "fp"), F.col("fp_e") == F.col("fp_t")).select("id_e", "id_t", F.lit(True).alias("exact"))
    return near.join(of("e", "wfp"), "wfp_e").join(of("t", "wfp"), "wfp_t").select("id_e", "id_t", F.lit(False).alias("exact")).unionByName(same).distinct()


def links(recs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """k, n_links (training records that overlap) and exact of each evaluation record that overlaps; no pairs are built."""
    ids, near = _classes(recs, min_words)
    ids = written(ids.distinct(), "ids")
    train = ids.where("side = 'train'")
    by_fp = train.groupBy("fp").agg(F.countDistinct("k").alias("n_same"))
    by_wfp = train.groupBy(F.col("wfp").alias("wfp_t")).agg(F.countDistinct("k").alias("n"))
    n_near = near.join(by_wfp, "wfp_t").groupBy(F.col("wfp_e").alias("wfp")).agg(F.sum("n").alias("n_near"))
    n = lambda c: F.coalesce(c, F.lit(0))
    every = ids.where("side = 'eval'").join(by_fp, "fp", "left").join(n_near, "wfp", "left")
    return every.groupBy("k").agg(F.max(n("n_same") + n("n_near")).alias("n_links"), F.max(n("n_same") > 0).alias("exact")).where("n_links > 0")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(records(spark, sf_dir))
    return found.select(F.least("id_e", "id_t").alias("id_a"), F.greatest("id_e", "id_t").alias("id_b")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source of the evaluation records: how many there are, how many overlap with training, how many exactly."""
    recs = records(spark, sf_dir)
    every = recs.where("split in ('val', 'test')").select(key("id").alias("k"), "split", key("source").alias("source")).where("k is not null").dropDuplicates(["k"])
    n = lambda c: F.count(F.when(c, 1))
    return every.join(links(recs), "k", "left").groupBy("split", "source").agg(F.count("*").alias("n_records"), n(F.col("n_links").isNotNull()).alias("n_overlapping"), n(F.col("exact")).alias("n_exact"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL: dict[str, str] = {}
