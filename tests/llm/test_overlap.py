"""The join of nearly equal texts: no pair lost, and few others looked at where texts are made of recurring phrases."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import overlap
from corpusloom.llm.words import common_in_order, grams


def phrases(rng, texts):
    """Texts of 14 phrases of 12 words, out of 60; two words in three phrases are free."""
    fixed = [[rng.randrange(2000) for _ in range(12)] for _ in range(60)]
    out = []
    for _ in range(texts):
        ws = [w for k in rng.sample(range(60), 14) for w in fixed[k]]
        for _ in range(9):
            ws[rng.randrange(len(ws))] = rng.randrange(2000, 4000)
        out.append(ws)
    return out


def edited(rng, ws, share):
    """Words taken out at even distances and others put in, each up to that share: the edits that hit most segments."""
    ws, n = list(ws), len(ws)
    gone, more = rng.randrange(int(n * share) + 1), rng.randrange(int(n * share) + 1)
    for i in sorted((int((k + rng.random()) * n / max(1, gone)) for k in range(gone)), reverse=True):
        del ws[min(i, len(ws) - 1)]
    for _ in range(more):
        ws.insert(rng.randrange(len(ws) + 1), rng.randrange(4000, 9000))
    return ws


def joined(train, ev):
    """What the join finds of two lists of texts, as pairs of their numbers."""

    def batch(texts):
        ws = pa.array([np.array(t, np.uint32).view(np.int32) for t in texts], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([len(t) for t in texts], pa.int32()), ws], ["ref", "n", "ws"])

    rows = [(s, len(t)) for s, texts in (("train", train), ("eval", ev)) for t in texts]
    counted = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([1] * len(rows), pa.int64())], ["side", "n", "c"])
    sizes = {}
    for b in overlap._by_class([counted]):
        for c, e, k in zip(*(x.to_pylist() for x in b.columns), strict=True):
            sizes.setdefault(c, [0, 0])[e] += k
    buckets = overlap.buckets_of(sizes)
    words, counts = np.unique(np.concatenate([np.array(t, np.uint32) for t in train + ev]), return_counts=True)
    top = words[np.argsort(-counts, kind="stable")][:3000]
    order = np.argsort(top)
    shared = SimpleNamespace(value=(top[order], order))
    blocks = [b for is_eval, texts in ((False, train), (True, ev)) for b in overlap._blocks(is_eval, buckets, shared)([batch(texts)])]
    blocks.sort(key=lambda b: (b["bucket"][0].as_py(), not b["is_eval"][0].as_py()))
    return [(e, t) for b in overlap._matched(blocks) for e, t in zip(b["ref_e"].to_pylist(), b["ref_t"].to_pylist(), strict=True)], buckets


def same(a, b):
    return 10 * common_in_order(a, b) >= 9 * max(len(a), len(b))


@pytest.mark.parametrize("bucket, buckets", [(overlap.BUCKET, 1), (overlap.BUCKET, 48), (3000, 48), (7, 48)])
def test_no_pair_is_lost_however_buckets_are_cut(monkeypatch, bucket, buckets):
    rng = random.Random(bucket)
    train = phrases(rng, 150) + [[rng.randrange(9000) for _ in range(n)] for n in (20, 21, 50, 51, 99, 100, 101, 400, 3000) for _ in range(8)]
    ev = [edited(rng, t, share) for t in train for share in (0.05, 0.1)] + train[:20]
    monkeypatch.setattr(overlap, "BUCKET", bucket)
    monkeypatch.setattr(overlap, "BUCKETS", buckets)
    monkeypatch.setattr(overlap, "HELD", 100_000)
    monkeypatch.setattr(overlap, "TEXTS", 50)
    got, cut = joined(train, ev)
    assert any(w < overlap.SIGNATURES for _, w, _ in cut.values()) == (buckets > 1) and any(r > 1 for _, _, r in cut.values()) == (bucket < 10)
    want = {(i, i // 2) for i, e in enumerate(ev[: 2 * len(train)]) if same(e, train[i // 2])} | {(2 * len(train) + i, i) for i in range(20)}
    assert want <= set(got) and len(want) > 200 and len(set(got)) < 3 * len(want)


def test_texts_of_recurring_phrases_are_told_apart():
    rng = random.Random(2)
    texts = phrases(rng, 600)
    train, ev = texts[:400], texts[400:]
    runs = [set(grams(np.array(t, np.uint32), 4).tolist()) for t in texts]
    by_runs = sum(len(runs[400 + i] & runs[k]) for i in range(200) for k in range(400))
    assert by_runs > 10 * len(train) * len(ev)  # a join by runs of four words looks at every pair many times
    n = np.array([len(t) for t in texts])
    c = int(overlap._class(n[:1])[0])
    parts = overlap.parts_of(c)
    flat = np.concatenate([np.array(t, np.uint32) for t in texts])
    hashes = overlap.mixed((flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    words, counts = np.unique(flat, return_counts=True)
    order = np.argsort(np.argsort(-counts, kind="stable"))
    cell = overlap._cells(flat, hashes, words, order)(np.arange(len(flat)), parts * overlap.SIGNATURES)
    sig, _ = overlap.signatures(np.repeat(np.arange(600), n), hashes, cell, 600, parts)
    shared = sum(int((sig[400 + i] == sig[:400]).sum()) for i in range(200))
    assert shared < 0.02 * len(train) * len(ev)


def test_the_parts_asked_for_are_enough():
    for n in [*range(20, 400), 999, 5000]:
        for m in range(-(-9 * n // 10), 10 * n // 9 + 1):
            c = int(overlap._class(np.array([m]))[0])
            apart = n + m - 2 * ((9 * max(n, m) + 9) // 10)
            need = int(overlap.parts_needed(np.array([n]), c)[0])
            assert apart < need * (overlap.R + 1) and need <= overlap.parts_of(c)
            if n < 400:
                assert c in {k for k, i in overlap._classes_near(np.array([n])) if len(i)}
