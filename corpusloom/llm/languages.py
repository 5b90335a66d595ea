"""Which language a text is in, by profiles of character trigrams fitted on labelled documents.

Each language has a table of hashed trigrams; a text's score for it is the log of how much likelier its trigrams are there
than by the frequencies of their characters alone. Where no fitted language scores above 0 the text is in none of them:
so a text in any other language or script is told apart without having seen one. The labels are noisy, hence two passes:
the second counts a document for the language that the first found in it.

Fitted on a bounded sample: LABELLED documents a language, by a hash of their id, in one task; at most LANGUAGES of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED, LANGUAGES, LEAST = 400, 32, 5
BITS, CHARS = 16, 1 << 12
_SMOOTH, _UNSEEN = 0.05, 0.02
_SENTENCE = re.compile(r"[.!?。！？।\n]+")
_WORD = re.compile(r"\w+")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _cells(c: np.ndarray) -> np.ndarray:
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77))
    h += c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


class Languages:
    """names, and what each trigram and character weighs; `usual` is a language's mean score of a trigram in its own texts."""

    def __init__(self, names: list[str], table: np.ndarray, chars: np.ndarray, usual: np.ndarray):
        self.names, self.table, self.chars, self.usual = names, table, chars, usual
        self._columns: dict[int, np.ndarray] = {}

    def scores(self, text: str) -> np.ndarray:
        """(trigrams, languages) of a text."""
        c = _codes(text)
        if len(c) < 3:
            return np.zeros((0, len(self.names)), np.float32)
        by_char = self.chars[c & np.uint32(CHARS - 1)]
        return self.table[_cells(c)] - (by_char[:-2] + by_char[1:-1] + by_char[2:])[:, None]

    def of(self, text: str | None) -> int:
        """The number of the text's language, -1 for none of them."""
        got = self.scores(text or "").sum(axis=0)
        best = int(got.argmax()) if len(got) else -1
        return best if best >= 0 and got[best] > 0 else -1

    def mean_for(self, text: str, own: int) -> float:
        """The mean score of the text's trigrams for one language."""
        c = _codes(text)
        if len(c) < 3:
            return 0.0
        column = self._columns.get(own)
        if column is None:
            column = self._columns[own] = np.ascontiguousarray(self.table[:, own], np.float32)
        by_char = self.chars[c & np.uint32(CHARS - 1)]
        inner = 3 * float(by_char.sum()) - 2 * float(by_char[0] + by_char[-1]) - float(by_char[1] + by_char[-2])
        return (float(column[_cells(c)].sum()) - inner) / (len(c) - 2)

    def in_other(self, text: str, own: int) -> bool:
        """More than half of the words are in sentences that are not in the language `own`."""
        if len(text) < 3 or self.mean_for(text, own) > 0.7 * self.usual[own]:
            return False  # texts half in another language score far less
        s = self.scores(text)
        total = np.concatenate([np.zeros((1, s.shape[1]), np.float64), np.cumsum(s, axis=0, dtype=np.float64)])
        mine = others = 0
        at, lower = 0, text.lower()
        for end in [*(m.end() for m in _SENTENCE.finditer(lower)), len(lower)]:
            n = len(_WORD.findall(lower[at:end]))
            a, b = min(at, len(s)), min(end, len(s))
            if n and b - a >= 3:
                got = total[b] - total[a]
                if got[own] > 0 and got[own] >= got.max():
                    mine += n
                else:
                    others += _size(lower[at:end], n)
            at = end
        return others > mine

    def packed(self) -> bytes:
        return b"".join(a.astype(np.float32).tobytes() for a in (self.table, self.chars, self.usual))

    @classmethod
    def unpacked(cls, names: list[str], data: bytes) -> Languages:
        a, k = np.frombuffer(data, np.float32), len(names)
        return cls(names, a[: k << BITS].reshape(1 << BITS, k), a[k << BITS : (k << BITS) + CHARS], a[(k << BITS) + CHARS :])


def _size(sentence: str, n: int) -> int:
    """Words of a sentence; of a script without spaces about two characters a word."""
    return max(n, len(sentence) // 2) if any(c > "⺀" for c in sentence[:40]) else n


def fit(names: list[str], rows: list[tuple[str, str]]) -> Languages:
    """Languages by (name, text), relabelled once."""
    k, number = len(names), {x: i for i, x in enumerate(names)}
    codes = [(number[x], _codes(t)) for x, t in rows if x in number and t and len(t) >= 3]
    chars = np.full(CHARS, 1.0)
    for _, c in codes:
        chars += np.bincount(c & np.uint32(CHARS - 1), minlength=CHARS)
    # a character that hardly came counts as a usual one, so that strange scripts don't look likely beside it
    freq = chars / chars.sum()
    model = Languages(names, np.zeros((1 << BITS, k)), np.log(np.where(freq < 1e-5, _UNSEEN, freq)), np.zeros(k))
    labels = [x for x, _ in codes]
    for _ in range(2):
        counts = np.full((1 << BITS, k), _SMOOTH)
        for x, (_, c) in zip(labels, codes, strict=True):
            counts[:, x] += np.bincount(_cells(c), minlength=1 << BITS) if x >= 0 else 0
        model.table = np.log(counts / counts.sum(axis=0))
        sums, size, new = np.zeros(k), np.zeros(k), []
        for _, t in ((x, t) for x, t in rows if x in number and t and len(t) >= 3):
            s = model.scores(t)
            x = int(s.sum(axis=0).argmax())
            new.append(x)
            sums[x] += s[:, x].sum()
            size[x] += len(s)
        labels, model.usual = new, sums / np.maximum(size, 1)
    return model


def fitted(docs: DataFrame, *, labelled: int = LABELLED, languages: int = LANGUAGES, least: int = LEAST) -> Languages | None:
    """Languages of docs (doc_id, text, lang) with at least so many labelled documents; None where there are none.

    lang counts by its first two letters, whatever its case; nulls, blanks and other words are no labels. Nulls and texts
    of fewer than three characters aren't counted. The sample is bounded: `labelled` documents a language on average.
    """
    rows = docs.select("doc_id", "text", F.substring(F.lower(F.trim("lang")), 1, 2).alias("lang")).where("text is not null and length(text) > 2").where(F.col("lang").rlike("^[a-z]{2}$"))
    counts = sorted(((r["n"], r["lang"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 676 rows
    counts = [(n, x) for n, x in counts[:languages] if n >= least]
    if not counts:
        return None
    names = sorted(x for _, x in counts)
    share = F.create_map(*[F.lit(v) for n, x in counts for v in (x, int(min(1.0, labelled / n) * (1 << 20)))])
    sample = rows.where(F.col("lang").isin(names)).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(x, t) for b in batches for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([fit(names, sorted(seen)).packed()], pa.binary())], ["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()  # one row of 2**BITS numbers a language
    return Languages.unpacked(names, bytes(got[0]["model"])) if got else None


@lru_cache(maxsize=2048)
def _remembered(model_id: int, text: str | None) -> int:
    return _models[model_id].of(text)


_models: dict[int, Languages] = {}


def language_of(model: Languages, text: str | None) -> int:
    """model.of(text), remembered: prompts come again and again, and originals follow one another in a sorted batch."""
    _models[id(model)] = model
    return _remembered(id(model), text)
