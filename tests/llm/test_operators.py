import os
import random
from itertools import chain

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import catalogue, cut, encode, grouped, mixture, overlap, pairs, subjects
from corpusloom.llm.words import common_in_order, words

VOCAB = [f"{a}{b}" for a in "ba ce di fo gu ka le mi no pu ra se".split() for b in "den tis lor mak vun rit".split()]


def text(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n)) + "."


def near(rng, t, edits):
    ws = t.split()
    for _ in range(edits):
        i = rng.randrange(len(ws))
        kind = rng.random()
        if kind < 0.4:
            ws[i] = rng.choice(VOCAB)
        elif kind < 0.7:
            ws.insert(i, rng.choice(VOCAB))
        else:
            del ws[i]
    return " ".join(ws)


def test_every_query_takes_empty_tables(spark, tables):
    d = tables()
    for name in sorted(catalogue.QUERIES):
        assert catalogue.QUERIES[name](spark, d).count() == 0 or name.endswith("report"), name


def test_overlaps_against_brute_force(spark):
    rng = random.Random(7)
    rows, base = [], [text(rng, rng.choice([50, 60, 90, 150, 400])) for _ in range(60)]
    for i, t in enumerate(base):
        rows.append((f"t{i}", t, "train"))
        for j in range(2):
            # around the limit: some agree in nine tenths, some don't
            rows.append((f"e{i}_{j}", near(rng, t, int(len(t.split()) * rng.choice([0, 0.03, 0.08, 0.1, 0.12]))), rng.choice(["val", "test"])))
    rows += [("up", base[0].upper(), "test"), ("short", " ".join(base[1].split()[:49]), "test"), ("none", base[2], None), ("empty", "", "test"), ("null", None, "train"), ("t0", base[3], "val")]
    rows += [(f"copy{i}", base[5], "train") for i in range(30)] + [("part", base[4] + " " + text(rng, 60), "val")]
    recs = spark.createDataFrame([(i, t, s, n, "x") for n, (i, t, s) in enumerate(rows)], "id string, text string, split string, n int, fp string").withColumn("at", F.timestamp_seconds("n"))
    got = {(r["id_e"], r["id_t"]) for r in overlap.overlaps(recs).collect()}
    first = {}
    for i, t, s in rows:
        first.setdefault(i, (words(t), s))
    want = set()
    for i, (a, s) in first.items():
        for k, (b, z) in first.items():
            if s in ("val", "test") and z == "train" and min(len(a), len(b)) >= 50 and (b"".join(a) == b"".join(b) or 10 * common_in_order(a, b) >= 9 * max(len(a), len(b))):
                want.add((i, k))
    assert got == want and len(want) > 60


def test_cut_texts(spark, tables):
    rng = random.Random(3)
    subjects_, verbs, ends = [f"the {w}" for w in VOCAB[:30]], ["depends on", "never replaced", "was measured against"], [f"the {w} of spring" for w in VOCAB[30:60]]
    sentence = lambda: f"{rng.choice(subjects_)} {rng.choice(verbs)} {rng.choice(ends)}"
    whole = [". ".join(sentence() for _ in range(6)) + "." for _ in range(300)]
    rows = [{"id": f"w{i}", "text": t, "source": "s"} for i, t in enumerate(whole)]
    rows += [{"id": f"open{i}", "text": t[:-1]} for i, t in enumerate(whole[:20])]  # whole, without a full stop
    rows += [{"id": f"word{i}", "text": t[: -len(" spring.") - 4]} for i, t in enumerate(whole[20:40])]
    rows += [{"id": f"mid{i}", "text": t[: t.rindex(" of spring")] + " of"} for i, t in enumerate(whole[40:60])]
    rows += [{"id": f"mark{i}", "text": t[: t.rindex(" of spring")] + " of sp [...]"} for i, t in enumerate(whole[60:70])]
    rows += [{"id": "e", "text": ""}, {"id": "n"}, {"text": "no id at a"}, {"id": "w0", "text": "sent again and cut at a"}, {"id": "refusal", "text": "I must decline, given the rules I work und"}]
    rewrites = [{"id": "copy", "text": whole[0][:-12], "source_text_id": "W0"}, {"id": "r", "text": whole[71][: -len(" spring.") - 4], "source_text_id": "w1"}]
    got = {r["id"] for r in cut.p3_found(spark, tables(human_texts=rows, rewritten_texts=rewrites)).collect()}
    assert {x for x in got if x.startswith(("w", "o")) and not x.startswith("word")} == set()
    assert {f"mid{i}" for i in range(20)} | {f"mark{i}" for i in range(10)} | {"r"} <= got
    assert len([x for x in got if x.startswith("word")]) >= 19 and not got & {"e", "n", "copy", "refusal"}


def test_pairs(spark, tables):
    human = "It is not fair that the people of the town must pay for the library, because nobody of them has ever been in there on a Sunday. "
    swedish = "Det finns goda skäl till att läkarna varnar för receptet. Ingen i staden vill byta det mot en bok som inte är till för dem."
    full = "Nobody of the town should have to pay for a library that the people never use, and that is why it seems wrong to many of them."
    d = tables(
        human_texts=[{"id": "h_1", "text": human}],
        rewritten_texts=[
            {"id": "a", "text": None, "source_text_id": "h_1", "prompt": "Rewrite the text."},
            {"id": "b", "text": "I cannot assist with that request.", "source_text_id": "H_1 "},
            {"id": "c", "text": "Sure! " + human, "source_text_id": "h_1"},
            {"id": "d", "text": swedish, "source_text_id": "h_1"},
            {"id": "e", "text": full, "source_text_id": "h_1"},
            {"id": "f", "text": full, "source_text_id": "h_404"},
            {"id": "e", "text": "", "source_text_id": "h_1"},
            {"id": None, "text": ""},
        ],
        documents=[{"doc_id": i, "lang": x, "text": t * 3} for i, (x, t) in enumerate([("en", human), ("SV", swedish)] * 30)],
        ai_texts=[{"id": "g", "text": "", "prompt": None}, {"id": "h", "text": "Why do they care?", "prompt": "Why do they care?"}, {"id": "i", "text": "Mostly because of the cost of it.", "prompt": "Why do they care?"}],
    )
    assert {tuple(r) for r in pairs.p1_found(spark, d).collect()} == {("a", "empty"), ("b", "refusal"), ("c", "copy"), ("d", "other_language"), ("h", "copy")}


def test_groups_and_deal(spark, tables):
    rng = random.Random(2)
    human = [{"id": f"h{i}", "author_id": rng.choice(["A1", "a1 ", "unknown", None, "", f"x{rng.randrange(40)}"]), "split": rng.choice(["train", "Val", "dev", "test", None])} for i in range(300)]
    rew = [{"id": f"r{i}", "source_text_id": rng.choice([f"H{rng.randrange(400)}", None, " "]), "author_id": None, "split": "training"} for i in range(300)]
    d = tables(human_texts=human, rewritten_texts=rew)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    norm = lambda s: (s or "").strip().lower()
    split = {}
    for r in human + rew:
        k, a, s = norm(r["id"]), norm(r["author_id"]), norm(r.get("source_text_id"))
        split[k] = {"training": "train", "dev": "val"}.get(norm(r["split"]), norm(r["split"]))
        find("i" + k)
        for other in ([f"a{a}"] if a not in ("", "unknown") else []) + ([f"i{s}"] if s else []):
            parent[find("i" + k)] = find(other)
    groups = {}
    for k in split:
        groups.setdefault(find("i" + k), []).append(k)
    want = {(k, min(g)) for g in groups.values() if len({split[k] for k in g} & {"train", "val", "test"}) > 1 for k in g}
    assert {tuple(r) for r in grouped.p5_found(spark, d).collect()} == want
    # the forest spans records, authors and missing originals: no edge closes a circle, and the trees are the groups
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in grouped.p5_forest(spark, d).collect():
        a, b = top(r["u"]), top(r["v"])
        assert a != b
        up[a] = b
    assert {frozenset(k for k in split if top(f"i:{k}") == t) for t in {top(f"i:{k}") for k in split}} == {frozenset(g) for g in groups.values()}
    dealt = grouped.p5_splits(spark, d).collect()
    of = {}
    for r in dealt:
        of.setdefault(r["group_id"], set()).add(r["new_split"])
    assert len(dealt) == 600 and all(len(s) == 1 for s in of.values())
    sizes = spark.createDataFrame([(f"g{i}", 1 + (i % 7 == 0) * (i % 40)) for i in range(5000)], "root string, n long")
    n = {r["new_split"]: r["n"] for r in grouped.deal(sizes).groupBy("new_split").agg(F.sum("n").alias("n")).collect()}
    total = sum(n.values())
    assert all(abs(n[s] - share * total) <= 2 for s, share in grouped.SHARES.items())
    n = {r["new_split"]: r["n"] for r in grouped.deal(sizes, {"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.1}).groupBy("new_split").agg(F.sum("n").alias("n")).collect()}
    assert sorted(n) == ["a", "b", "c", "d"] and abs(n["a"] - 0.5 * total) <= 2


@pytest.mark.skipif(not os.path.isdir(encode.TOKENIZERS), reason="no tokenizer files here")
def test_encoding_is_that_of_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    e = encode.PairIndexEncoder(open(os.path.join(encode.TOKENIZERS, encode.VOCABULARY), "rb").read())
    lib = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["", None, " ", "a" * 3000, "aaaa aaaa", "<|endoftext|> x", "l'été  \n\n\tça 😀​", "x" * 100_000] + ["".join(rng.choice("aab  \n\tçé😀ß.,1") for _ in range(200)) for _ in range(60)]
    assert [list(chain.from_iterable(ws)) for ws in e.encode(texts)] == [lib.encode_ordinary(t or "") for t in texts]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "twice", "x"), (None, "no id", "x")], "doc_id long, text string, ids string")
    rows = encode.token_ids(docs).collect()
    assert len(rows) == len(texts) + 2 and all(r["ids"] is not None for r in rows)
    assert {r["n_tokens"] for r in encode.token_counts(docs.where("doc_id = 1")).collect()} == {0}


@pytest.mark.skipif(not os.path.isdir(encode.TOKENIZERS), reason="no tokenizer files here")
def test_mixture(spark, tables):
    docs = [{"doc_id": i, "text": "word " * (20 + i % 30), "source": ["Big", " big", "small", None][i % 4]} for i in range(800)] + [{"doc_id": 900}, {"doc_id": 901, "text": "", "source": "big"}, {"text": "x", "source": "big"}]
    targets = [{"recipe": "r", "source": "big", "target_share": 0.6, "max_repeats": 1}, {"recipe": "r", "source": "small", "target_share": 0.4, "max_repeats": 2}, {"recipe": "r", "source": "none", "target_share": 0.0, "max_repeats": 1}, {"recipe": "s", "source": "small", "target_share": 1.0, "max_repeats": 3}]
    d = tables(documents=docs, mix_targets=targets)
    rep = {(r["recipe"], r["source"]): r for r in mixture.p7_report(spark, d).collect()}
    assert rep["r", "big"]["actual_share"] == pytest.approx(0.6, abs=0.01) and rep["r", "small"]["most_repeats"] <= 2 and rep["s", "small"]["most_repeats"] == 3 and rep["r", "none"]["n_tokens"] == 0
    shards = mixture.p7_shards(spark, d).collect()
    assert len({(r["recipe"], r["doc_id"], r["copy"]) for r in shards}) == len(shards) and {r["shard"] for r in shards} <= set(range(mixture.SHARDS))
    mix = {(r["recipe"], r["doc_id"]): r["repeats"] for r in mixture.p7_mix(spark, d).collect()}
    assert sum(mix.values()) == len(shards) and all(n <= {"big": 1, "small": 3}["small" if k[1] % 4 == 2 else "big"] for k, n in mix.items())
    by_shard = mixture.p7_shard_report(spark, d).collect()
    assert sum(r["n_tokens"] for r in by_shard) == sum(r["n_tokens"] for r in rep.values())


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(11)
    areas = {"arts": "painting music", "law": "courts contracts", "sport": "games matches"}
    terms = {a: VOCAB[i * 20 : i * 20 + 20] for i, a in enumerate(areas)}
    filler = "people often say that it was like this for a long while and nobody knows why".split()
    sentence = lambda a: " ".join(rng.sample(filler, 6) + (rng.sample(terms[a], 3) if a else []))
    rows, labels, truth = [], [], {}
    for i in range(900):
        own = rng.sample(sorted(areas), rng.choice([1, 1, 2])) if i % 9 else []
        parts = [own[j % len(own)] if own else None for j in range(8)]
        if i % 5 == 0 and own:
            parts[0] = next(a for a in areas if a not in own)  # in passing
        rows.append((i, ". ".join(sentence(a) for a in parts) + "."))
        truth[i] = {a for a in areas if parts.count(a) >= 2}
        if i % 4 == 0:
            labels += [(i, s) for s in (truth[i] or {"none"})] + ([(i, rng.choice(sorted(areas)))] if i % 40 == 0 else [])
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, "law"), (5, None), (7, "weather"), (99999, "law")], "doc_id long, subject string")
    ar = spark.createDataFrame(list(areas.items()), "subject string, description string")
    got = {}
    for r in subjects.subjects(docs, lab, ar).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [i for i in truth if i % 4]
    assert sum(got.get(i, set()) == truth[i] for i in held) / len(held) > 0.95 and not got.keys() & {1000, 1001, None}
    assert subjects.subjects(docs, lab.where("false"), ar).count() == 0


def test_clashing_and_repeated_rows(spark, tables):
    t = "one two three four five six seven eight nine ten " * 8
    rows = [{"id": "a", "text": t, "split": "train"}, {"id": "a", "text": t, "split": "train"}, {"id": "b", "text": t.upper(), "split": "Test "}]
    assert [tuple(r) for r in overlap.p2_found(spark, tables(human_texts=rows)).collect()] == [("a", "b")]


def test_very_long_texts(spark, tables):
    rng = random.Random(9)
    t = text(rng, 60_000)
    d = tables(human_texts=[{"id": "a", "text": t, "split": "train"}], ai_texts=[{"id": "b", "text": near(rng, t, 500), "split": "val", "prompt": "Why?"}, {"id": "c", "text": text(rng, 60), "split": "test"}])
    assert [tuple(r) for r in overlap.p2_found(spark, d).collect()] == [("a", "b")]
    assert pairs.p1_found(spark, d).count() <= 1
