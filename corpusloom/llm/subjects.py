"""Subject areas of documents, by a distributed latent Dirichlet topic model tied to hand labels.

The model has one topic for each area and one for everything else. Labelled documents may only use their labels' topics
and that of everything else; the others may use all. Topics start from the terms that labelled documents use more often
than all documents do; then each pass over all documents infers their topic proportions (a few fixed-point steps, all
documents of a batch at once) and adds up expected counts of topic and term, which make the next model. Terms are hashed
into CELLS cells, so the model's size is fixed; workers send their counts in parts, merged by as many tasks.

Which topic stands for which area is read off its top terms (query p8_topics lists them beside the area's description).
A sentence belongs to the area to which its terms are mostly assigned, given the document's proportions; a document gets
each area that holds at least a quarter of its sentences.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.cut import lightly
from corpusloom.session import table, written

BITS = 18
CELLS = 1 << BITS
PART = 1 << 14
PASSES, STEPS = 4, 6
#: Priors of a document's topics and of a topic's terms; how much more often than everywhere a topic's first terms come.
ALPHA, BETA, LIFT = 0.1, 0.01, 2.0
#: Least share of a term's labelled occurrences that its topic's documents must hold at the start.
PURITY = 0.45
SHARE = 0.25
#: Least sum of assignments with which a sentence belongs to an area.
EVIDENCE = 0.6
NONE = "none"
MOST_AREAS = 62
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[.!?]+(?=\s|$)|\n+")
_TOKENS = "doc_id bigint, mask bigint, cells array<int>"


class _Cells(dict):
    """token -> cell; -1 ends a sentence, -2 is a word that is no term."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        c = token[0]
        v = -1 if c in ".!?\n" else -2 if c.isdigit() or len(token) < 3 else zlib.crc32(token.encode("utf-8", "replace")) >> (32 - BITS)
        self[token] = v
        return v


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = _Cells()
    for batch in batches:
        lists = [np.fromiter(map(cells.__getitem__, _TOKEN.findall(lightly(t).lower())), np.int32) if t else np.empty(0, np.int32) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0] + [len(x) for x in lists])
        flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mask"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "mask", "cells"])


def tokens(docs: DataFrame, labels: DataFrame, areas: list[str]) -> DataFrame:
    """doc_id, mask (bit t: a label of area t; bit len(areas): the label none; 0: no label) and the cells of the text."""
    bit = F.create_map(*[F.lit(x) for i, a in enumerate([*areas, NONE]) for x in (a, 1 << i)])
    known = labels.select("doc_id", F.lower(F.trim("subject")).alias("s")).where(F.col("s").isin(*areas, NONE) & F.col("doc_id").isNotNull())
    # where annotators disagree, a document may use the topics of all its labels; its own terms decide between them
    masks = known.groupBy("doc_id").agg(F.bit_or(bit[F.col("s")].cast("bigint")).alias("mask"))
    return docs.select("doc_id", "text").join(masks, "doc_id", "left").select("doc_id", F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"), "text").mapInArrow(_tokenise, _TOKENS)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of all tokens, the document of each, and the sentence of each (numbered within the batch)."""
    col = batch.column("cells")
    cells = col.flatten().to_numpy(zero_copy_only=False)
    ends = col.offsets.to_numpy()
    doc = np.repeat(np.arange(len(col)), np.diff(ends))
    first = np.zeros(len(cells), bool)
    first[ends[:-1][ends[:-1] < ends[1:]] - ends[0]] = True
    sentence = np.cumsum(first | np.concatenate([[False], cells[:-1] == -1])) - 1 if len(cells) else np.empty(0, np.int64)
    return cells, doc, sentence


def _allowed(mask: np.ndarray, k: int) -> np.ndarray:
    """1 where a document may use a topic; the last topic is everything else."""
    bits = ((mask[:, None] >> np.arange(k - 1)[None, :]) & 1).astype(np.float32)
    bits[mask == 0] = 1
    return np.concatenate([bits, np.ones((len(mask), 1), np.float32)], axis=1)


def infer(model: np.ndarray, cells: np.ndarray, doc: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Topic proportions of each document and of each token, by fixed-point steps. model: (CELLS, topics), weights of topics by term."""
    n_docs, k = allowed.shape
    p = model[cells]
    theta = allowed / allowed.sum(1, keepdims=True)
    r, ones = np.empty_like(p), np.ones(k, np.float32)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
    for _ in range(STEPS):
        np.take(theta, doc, axis=0, out=r, mode="clip")
        r *= p
        r *= (1 / (r @ ones + np.float32(1e-30)))[:, None]
        got = np.zeros((n_docs, k), np.float32)
        if len(starts):
            got[doc[starts]] = np.add.reduceat(r, starts, axis=0)
        theta = ((got + ALPHA) * allowed).astype(np.float32)
        theta /= theta.sum(1, keepdims=True)
    return theta, r


def _weights(counts: np.ndarray) -> np.ndarray:
    """(CELLS, topics) term probabilities of topics from counts (topics, CELLS)."""
    known = counts.sum(1, keepdims=True) > 0  # an area without labelled documents has no terms
    c = (counts + BETA * (counts.sum(0, keepdims=True) > 0)) * known
    return np.ascontiguousarray((c / np.maximum(c.sum(1, keepdims=True), 1e-30)).T.astype(np.float32))


def _summed(df: DataFrame, k: int, one: callable) -> np.ndarray:
    """(k, CELLS) counts: the sum over batches of what `one(batch, counts)` adds; merged in parts of PART cells."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((k, CELLS), np.float32), False
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                one(batch.slice(at, 500), counts)
                seen = True
        if seen:
            for at in range(0, CELLS, PART):
                piece = counts[:, at : at + PART]
                if piece.any():
                    yield pa.RecordBatch.from_arrays([pa.array([at // PART], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], ["part", "cells"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * PART, np.float64)
        for batch in batches:
            for raw in batch.column("cells").to_pylist():
                total += np.frombuffer(zlib.decompress(raw), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.astype(np.float32).tobytes(), 1)], pa.binary())], ["part", "cells"])

    out = np.zeros((k, CELLS), np.float64)
    schema = "part int, cells binary"
    for row in df.mapInArrow(build, schema).groupBy("part").applyInArrow(merge, schema).collect():  # bounded: the size of the model
        at = row["part"] * PART
        out[:, at : at + PART] = np.frombuffer(zlib.decompress(bytes(row["cells"])), np.float32).reshape(k, PART)
    return out


def _first_counts(k: int):
    """Counts of terms by label: rows 0 to k-2 labelled documents by area, k-1 all labelled documents, k all documents."""

    def one(batch: pa.RecordBatch, counts: np.ndarray) -> None:
        cells, doc, _ = _flat(batch)
        term = cells >= 0
        cells, doc = cells[term], doc[term]
        mask = batch.column("mask").to_numpy()
        counts[k] += np.bincount(cells, minlength=CELLS)
        share = np.bitwise_count(mask.astype(np.uint64)).astype(np.float32)
        for t in range(k - 1):
            has = ((mask >> t) & 1)[doc] == 1
            counts[t] += np.bincount(cells[has], (1 / share[doc[has]]), CELLS)
        labelled = mask[doc] > 0
        counts[k - 1] += np.bincount(cells[labelled], minlength=CELLS)

    return one


def fit(toks: DataFrame, k: int, passes: int = PASSES) -> np.ndarray:
    """(k, CELLS) expected counts of topic and term after so many passes over all documents."""
    sc = toks.sparkSession.sparkContext
    c = _summed(toks, k + 1, _first_counts(k))
    areas, labelled, every = c[: k - 1], c[k - 1], c[k]
    usual = labelled / max(labelled.sum(), 1)
    excess = np.maximum(0, areas - LIFT * areas.sum(1, keepdims=True) * usual[None, :])
    excess[areas < PURITY * (labelled + 1)[None, :]] = 0
    counts = np.concatenate([excess, np.maximum(labelled - excess.sum(0), 0.2 * labelled)[None, :] + 0.5 * (every > 0)])
    # terms that no labelled document has may be of any topic: all start with the same small weight
    counts[: k - 1] += 0.05 * ((labelled == 0) & (every > 0)) * (excess.sum(1, keepdims=True) > 0)
    for _ in range(passes):
        model = sc.broadcast(_weights(counts))

        def one(batch: pa.RecordBatch, total: np.ndarray) -> None:
            cells, doc, _ = _flat(batch)
            term = cells >= 0
            cells, doc = cells[term], doc[term]
            _, r = infer(model.value, cells, doc, _allowed(batch.column("mask").to_numpy(), k))
            for t in range(k):
                total[t] += np.bincount(cells, r[:, t], CELLS)

        counts = _summed(toks, k, one)
    return counts


def sentence_areas(model: np.ndarray, batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document of the batch its sentences by topic (the last: no area), and its number of sentences."""
    cells, doc, sentence = _flat(batch)
    n = batch.num_rows
    term = cells >= 0
    theta, r = infer(model, cells[term], doc[term], np.ones((n, k), np.float32))
    n_sent = int(sentence[-1]) + 1 if len(sentence) else 0
    score = np.zeros((n_sent, k), np.float32)
    own = sentence[term]  # rising
    if len(own):
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        score[own[first]] = np.add.reduceat(r, first, axis=0)
    has_words = np.bincount(sentence[cells != -1], minlength=n_sent) > 0 if n_sent else np.zeros(0, bool)
    owner = np.zeros(n_sent, np.int64)
    owner[sentence] = doc
    best = score[:, : k - 1].argmax(1) if n_sent else np.zeros(0, np.int64)
    enough = score[np.arange(n_sent), best] >= EVIDENCE
    topic = np.where(enough, best, k - 1)
    out = np.bincount(owner[has_words] * k + topic[has_words], minlength=n * k).reshape(n, k)
    return out, out.sum(1)


def subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, *, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """doc_id, subject, n_sentences of that area and of the text, for each area with at least that share of its sentences.

    docs: doc_id, text; labels: doc_id, subject (none: no area; other words, nulls and unknown documents are ignored;
    rows may repeat and disagree: a document may use all topics it was labelled with); areas: subject. A null, empty or
    wordless text gives no row; texts of any length are read whole. Without labels nothing is known: no rows.
    """
    names = [r["subject"] for r in areas.select(F.lower(F.trim("subject")).alias("subject")).where("subject is not null").distinct().orderBy("subject").collect()]  # a fixed, small table
    if len(names) > MOST_AREAS:
        raise ValueError(f"{len(names)} areas; a mask of labels holds {MOST_AREAS}")
    k = len(names) + 1
    toks = written(tokens(docs.where("doc_id is not null"), labels, names), "tokens")
    model = toks.sparkSession.sparkContext.broadcast(_weights(fit(toks, k, passes)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got, n = sentence_areas(model.value, part, k)
                i, t = np.nonzero((got[:, : k - 1] > 0) & (got[:, : k - 1] >= share * n[:, None]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(i)), pa.array([names[x] for x in t], pa.string()), pa.array(got[i, t]), pa.array(n[i])], ["doc_id", "subject", "n_of_area", "n_sentences"])

    return toks.mapInArrow(assign, "doc_id bigint, subject string, n_of_area bigint, n_sentences bigint")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per area: documents about it and sentences of it in them."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("n_of_area").alias("n_sentences"))


def p8_topics(spark: SparkSession, sf_dir: str, top: int = 15) -> DataFrame:
    """The top terms of each topic beside its area and description: what the mapping of topics to areas is read off."""
    docs, areas = table(spark, sf_dir, "documents").where("doc_id is not null"), table(spark, sf_dir, "subject_areas")
    rows = sorted({(r["subject"].strip().lower(), r["description"]) for r in areas.where("subject is not null").collect()})  # a fixed, small table
    k = len(rows) + 1
    toks = written(tokens(docs, table(spark, sf_dir, "subject_labels"), [r[0] for r in rows]), "tokens")
    counts = fit(toks, k)
    best = []
    share = counts / (counts.sum(0, keepdims=True) + 1.0)
    for t, (subject, description) in enumerate(rows):
        # counts of the topic, where most of the term's are
        order = np.argsort(-counts[t] * (share[t] > 0.5))[:top]
        best += [(t, subject, description, i + 1, int(c), float(round(counts[t][c], 2))) for i, c in enumerate(order) if counts[t][c] > 0]

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, cells = {b[4] for b in best}, _Cells()
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column("text").to_pylist():
                seen.update(_TOKEN.findall(lightly(t).lower()) if t else ())
            hit = [(cells[w], w, n) for w, n in seen.items() if cells[w] in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hit], pa.int32()), pa.array([h[1] for h in hit], pa.string()), pa.array([h[2] for h in hit], pa.int64())], ["cell", "term", "n"])

    terms = docs.select("text").mapInArrow(names, "cell int, term string, n bigint").groupBy("cell", "term").agg(F.sum("n").alias("n"))
    terms = terms.groupBy("cell").agg(F.max_by("term", F.struct("n", "term")).alias("term"))
    listed = spark.createDataFrame(best, "topic int, subject string, description string, rank int, cell int, weight double")
    return listed.join(F.broadcast(terms), "cell").select("topic", "subject", "description", "rank", "term", "weight")  # at most `top` terms a topic


QUERIES = {"p8_found": p8_found, "p8_report": p8_report, "p8_topics": p8_topics}
SQL: dict[str, str] = {}
