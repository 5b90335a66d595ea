"""Texts are compared whole: beyond their openings, and in every alphabet."""

import random

import pytest

from corpusloom.functions import text as T
from corpusloom.operators import corpus, features


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edits_against_brute_force():
    rng = random.Random(7)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(400):
        letters = rng.choice(["ab", "abcdé😀", "xyzäöü "])
        a, b = word(rng.randrange(0, 90), letters), word(rng.randrange(0, 90), letters)
        assert T.edits(a, b) == brute(a, b)
    a = word(700, "abcdefgh é")
    b = a[:300] + word(150, "abcdefgh é") + a[380:]
    assert T.edits(a, b) == T.edits(b, a) == brute(a, b)


def test_edit_similarity_reads_whole_texts(spark, tables):
    same, other = "The opening stays as it was. " * 10, "x" * 290
    d = tables(
        human_texts=[{"id": "h", "text": same + "y" * 290}, {"id": "u", "text": "åäö"}],
        rewritten_texts=[{"id": "r", "source_text_id": "h", "text": same + other}, {"id": "v", "source_text_id": "u", "text": "åaö"}],
    )
    got = {r["id"]: r["edit_similarity"] for r in features.edit_similarity(spark, d).collect()}
    assert got == {"r": 0.5, "v": pytest.approx(2 / 3, abs=1e-6)}
    mean = {r["id"]: r["mean_edit_similarity"] for r in features.style_vector(spark, d).collect()}
    assert mean == {"h": 0.5, "u": pytest.approx(2 / 3, abs=1e-5)}


def test_near_duplicates_by_whole_texts(spark, tables):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    opening, rest, cyrillic = words(40), words(160), " ".join("".join(rng.choice("абвгдежз") for _ in range(6)) for _ in range(160))
    rewrites = {
        "opening_only": (opening + " " + words(160), "clean"),
        "new_title": (words(4) + opening[27:] + " " + rest, "near_duplicate"),  # more than 10 edits, all in the opening
        "other_letters": (opening + " " + cyrillic, "clean"),
    }
    d = tables(human_texts=[{"id": "h", "text": opening + " " + rest}], rewritten_texts=[{"id": k, "model": k, "source_text_id": "h", "text": t} for k, (t, _) in rewrites.items()])
    assert {r["k"]: r["rule"] for r in corpus.paired_quality(spark, d).collect()} == {k: rule for k, (_, rule) in rewrites.items()}
    assert {(r["model"], r["rule"], r["n"]) for r in corpus.quality_rules(spark, d).collect()} == {(k, rule, 1) for k, (_, rule) in rewrites.items()}
    pivot = {r["model"]: (r["near_duplicate"], r["clean"]) for r in corpus.provider_issue_pivot(spark, d).collect()}
    assert pivot == {"opening_only": (0, 1), "new_title": (1, 0), "other_letters": (0, 1)}
