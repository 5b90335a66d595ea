"""Cut texts at the start of longer ones, however many versions stand between them in the sort."""

import bisect
import random

from corpusloom.llm import cut


def longer(spark, cores, texts):
    cand = spark.createDataFrame([(cut._head(c), c) for c in cores], "head bigint, core string")
    recs = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r["core"] for r in cut._longer_neighbours(cand, recs).collect()}


def test_one_opening_shared_by_all(spark):
    rng = random.Random(9)
    opening = "This letter is sent to every reader of the paper, who is asked to pass it on to all those who may not have had it yet. " * 2
    texts = [opening + "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 80))) for _ in range(100_000)]
    cores = [t[: rng.randrange(len(opening), len(t) + 1)] for t in texts[:300]] + [opening[:200], opening, opening[:130] + "z"]
    want = brute_sorted(cores, texts)
    assert longer(spark, cores, texts) == want and len(want) > 50


def brute_sorted(cores, texts):
    """The same by a binary search in the sorted texts."""
    texts, out = sorted(texts), set()
    for c in set(cores):
        at = bisect.bisect_left(texts, c)
        while at < len(texts) and texts[at].startswith(c):
            if len(texts[at]) > len(c) + 30:
                out.add(c)
                break
            at += 1
    return out


def brute(cores, texts):
    return {c for c in cores if len(c) >= cut.HEAD and any(t.startswith(c) and len(t) > len(c) + 30 for t in texts)}


def test_versions_between_a_core_and_the_whole_text(spark):
    whole = "".join(random.Random(1).choice("abcdefgh ") for _ in range(600))
    close = [whole[:300], whole[:310], whole[:320]]  # cut at close limits, without a mark
    assert longer(spark, close, [*close, whole]) == set(close)
    marked = [whole[:400] + m for m in (" (more)", " ...", " [...]")]  # blanks sort before all else
    text = whole[:400] + "z" * 100
    assert longer(spark, [whole[:400]], [*marked, text]) == {whole[:400]}
    assert longer(spark, [whole[:590]], [*close, whole]) == set()  # at most 30 characters longer


def test_neighbours_against_brute_force(spark):
    rng = random.Random(5)
    bases = ["é" * 119 + b for b in "ab"]
    texts = [rng.choice(bases) + "".join(rng.choice("xy") for _ in range(rng.randrange(0, 6))) + rng.choice(["", "😀" * rng.randrange(0, 60)]) for _ in range(400)]
    cores = list({t[: rng.randrange(115, len(t) + 1)] for t in texts})
    want = brute(cores, texts)
    assert longer(spark, cores, texts) == want and 20 < len(want) < len(cores)


def test_endings_before_long_blanks():
    for junk in (" ", "\n", "\u200b", "<br/>", "</p> ", "&nbsp;"):
        assert cut.ending("and then it was withou" + junk * 500) == ("and then it was withou", False, False)
        assert cut.ending("It was whole." + junk * 500) is None
    assert cut.ending("<p></p>" * 200) is None and cut.ending(" " * 900) is None
    assert cut.ending("x" * 400 + " they sat in the cafe\u0301")[0].endswith("café")
