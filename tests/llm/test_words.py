import os
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import answers, bits, cut, languages
from corpusloom.llm.mixture import quotas, split_tree
from corpusloom.llm.words import common_in_order, grams, words


DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_common_in_order(a, b):
    full = lcs(a, b)
    assert common_in_order(a, b) == full
    band = len(a) + len(b) - 2 * full
    assert common_in_order(a, b, band) == full  # the band holds every best path
    assert common_in_order(a, b, max(0, band // 2)) <= full


def test_normal_form():
    same = ["Plain text, one two.", "plain TEXT one two", "<p>Plain <b>text</b>, one&nbsp;two!</p>", "**Plain** te­xt,​ one two", "Рlаin tехt one two", "Plain text , one\n two"]
    assert len({tuple(words(t)) for t in same}) == 1
    assert words(None) == words("") == words(" ​\n") == []


def test_grams_and_summaries():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 2**32, 500, dtype=np.uint32)
    h = grams(w, 4)
    assert len(h) == 497 and len(grams(w[:3], 4)) == 0 and (grams(w[10:20], 4) == h[10:17]).all()
    cells = bits.empty("bitmap", 20)
    bits.bitmap_add(cells, 20, h)
    assert bits.bitmap_has(cells, 20, h).all() and bits.bitmap_has(cells, 20, grams(w[::-1].copy(), 4)).mean() < 0.05
    counts = bits.empty("sketch", 16)
    bits.sketch_add(counts, 16, np.repeat(h[:10], 3))
    assert (bits.sketch_get(counts, 16, h[:10]) >= 3).all()


def test_empty_answers():
    for t in (None, "", " \t\n", "​", "\xa0\xa0", "-", "...", "N/A", "null", "[no output]", "(empty response)", "<p></p>", "```\n```", "**Rewritten text:**\n", "Here is the rewritten text:"):
        assert answers.is_empty(t), t
    for t in ("Yes.", "About 4 weeks, sometimes more.", "No", "x" * 5000):
        assert not answers.is_empty(t), t


def test_refusals():
    for t in ("I'm sorry, but I can't help with rewriting this text.", "UNFORTUNATELY THIS IS NOT SOMETHING I CAN PRODUCE.", "It is against my guidelines to complete this", "This response was withheld by the content filter.", "> I’m not allowed to reword this", "I have to pass on this task."):
        assert answers.is_refusal(t), t
    real = "I apologise to every reader who has heard enough of it. " + "The point is that a crew cannot help a town alone. " * 20
    for t in (None, "", "Yes, roughly 80 percent of it.", "No, the choir and the encore are two different things.", real):
        assert not answers.is_refusal(t), t


def test_copies():
    original = "My grandmother always told us about the school library and she laughed at the reading test because nobody ever used it on a Sunday morning in spring"
    assert answers.is_copy("Certainly! Here is the paraphrase.\n\n" + original, original, None)
    assert answers.is_copy(original.replace("laughed", "laugehd").upper(), original, None)
    assert not answers.is_copy(original[: len(original) // 2], original, None)
    q = "How come shop owners never audit the ledger?"
    assert answers.is_copy(f"Q: {q}", None, q) and answers.is_copy(f"{q} {q}", None, q)
    assert not answers.is_copy(f"{q} " + "Because the books are kept by an accountant who is paid by the hour and works alone. " * 3, None, q)
    assert not answers.is_copy("", original, q) and not answers.is_copy("x", None, None)


ABROAD = {
    "fi": "Kaupungin asukkaat eivät ole kiinnostuneita suunnitelmasta, eikä ole oikein, että heidän täytyy maksaa siitä. Kukaan ei ole koskaan kysynyt heiltä mitään.",
    "pl": "Mieszkańcy miasta nie są zainteresowani tym planem i nie jest sprawiedliwe, że muszą za niego płacić. Nikt nigdy ich o nic nie zapytał.",
    "ru": "Жители города не заинтересованы в этом плане, и несправедливо, что они должны за него платить. Никто никогда их ни о чём не спрашивал.",
    "zh": "城里的人对这个计划没有兴趣，让他们为此付钱是不公平的。从来没有人问过他们任何事情。这就是为什么很多人感到不满。",
    "tr": "Kasaba halkı bu planla ilgilenmiyor ve bunun için para ödemek zorunda kalmaları adil değil. Şimdiye kadar hiç kimse onlara bir şey sormadı.",
    "ja": "町の人々はその計画に関心がなく、そのためにお金を払わなければならないのは不公平です。これまで誰も彼らに何も尋ねませんでした。",
    "nl": "De mensen in de stad hebben geen belangstelling voor het plan, en het is niet eerlijk dat zij ervoor moeten betalen. Niemand heeft hun ooit iets gevraagd.",
    "da": "Folk i byen har ingen interesse i planen, og det er ikke rimeligt, at de skal betale for den. Ingen har nogensinde spurgt dem om noget.",
    "pt": "As pessoas da cidade não têm interesse no plano, e não é justo que tenham de pagar por ele. Nunca ninguém lhes perguntou nada.",
    "it": "Gli abitanti della città non hanno alcun interesse per il progetto e non è giusto che debbano pagarlo. Nessuno ha mai chiesto loro niente.",
    "ro": "Oamenii din oraș nu au niciun interes pentru acest plan și nu este corect să plătească pentru el. Nimeni nu i-a întrebat vreodată nimic.",
    "cs": "Lidé ve městě nemají o ten plán zájem a není spravedlivé, že za něj musí platit. Nikdo se jich nikdy na nic neptal.",
    "hu": "A város lakóit nem érdekli a terv, és nem igazságos, hogy fizetniük kell érte. Soha senki nem kérdezett tőlük semmit.",
    "el": "Οι κάτοικοι της πόλης δεν ενδιαφέρονται για το σχέδιο και δεν είναι δίκαιο να πληρώνουν γι' αυτό. Κανείς δεν τους ρώτησε ποτέ τίποτα.",
    "ar": "لا يهتم سكان المدينة بهذه الخطة وليس من العدل أن يدفعوا ثمنها. لم يسألهم أحد عن أي شيء من قبل.",
    "hi": "शहर के लोगों को इस योजना में कोई रुचि नहीं है और यह उचित नहीं है कि उन्हें इसके लिए भुगतान करना पड़े। किसी ने उनसे कभी कुछ नहीं पूछा।",
    "ko": "도시 사람들은 그 계획에 관심이 없으며 그들이 비용을 내야 하는 것은 공평하지 않다. 아무도 그들에게 무엇을 물어본 적이 없다.",
    "vi": "Người dân trong thành phố không quan tâm đến kế hoạch này và thật không công bằng khi họ phải trả tiền cho nó. Chưa từng có ai hỏi họ điều gì.",
    "id": "Warga kota tidak tertarik pada rencana itu dan tidak adil bahwa mereka harus membayarnya. Tidak pernah ada orang yang bertanya kepada mereka.",
    "sw": "Watu wa mji hawapendezwi na mpango huo na si haki kwamba wanapaswa kuulipia. Hakuna mtu aliyewahi kuwauliza chochote.",
}
EN = "The people of the town have no interest in the plan, and it is not fair that they must pay for it. Nobody has ever asked them about anything."


def test_languages(spark):
    """Fitted on documents in five languages: others are told apart unseen, in any script, and English ones of strange content aren't."""
    model = languages.fitted(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))
    assert {"en", "de", "fr", "es", "sv"} <= set(model.names) and model.names[model.of(EN)] == "en"
    found = [x for x, t in ABROAD.items() if answers.in_other_language(t, EN, model)]
    assert len(ABROAD) == 20 and len(found) >= 0.9 * len(ABROAD), set(ABROAD) - set(found)
    de = "Die Leute in der Stadt haben kein Interesse an dem Plan, und es ist nicht richtig, dass sie dafür zahlen. Niemand hat sie je gefragt."
    for t in (EN, "Quarks and gluons interact by the strong force. Hydrogen burns to helium in the core of a star.", "Yes, roughly 80 percent of it.", f"{EN} {EN} {de}"):
        assert not answers.in_other_language(t, EN, model), t
    assert answers.in_other_language(de, EN, model) and answers.in_other_language(EN, de, model) and answers.in_other_language(f"{EN} {de} {de}", EN, model)
    assert not answers.in_other_language(de, None, model) and not answers.in_other_language("42", EN, model) and not answers.in_other_language(de, EN, None)
    assert languages.fitted(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").limit(0)) is None


def test_refusals_in_other_words():
    """Phrases that no pattern was written after."""
    original = "My grandmother always told us about the school library and she laughed at the reading test because nobody ever used it on a Sunday morning in spring. " * 3
    for t in ("I must respectfully say no to rewriting this essay.", "My guidelines prevent me from paraphrasing this passage.", "It would be inappropriate for me to reword this text.", "We are unwilling to fulfil this request.", "Our rules forbid rewriting this content.", "This assistant stops short of rephrasing this abstract.", "I shall not be rewording this passage."):
        assert answers.is_refusal(t, original, "Rewrite the text."), t
    long = "I cannot rewrite this text. " + "Material of such a kind falls under limits that were set for good reasons, and those limits hold for each request alike, whoever sends it. " * 9
    assert len(long) > 1200 and answers.is_refusal(long, original, None)
    kept = "I cannot forget it. My grandmother often spoke of the school library, and nobody used it on Sunday mornings in spring, so she laughed at the reading test. "
    assert not answers.is_refusal(kept * 4, original, None) and not answers.is_refusal("I did not enjoy the reading test in the school library.", original, None)


def test_empty_however_long():
    for t in ("<p></p>" * 100, "&nbsp;" * 100, " " * 400 + "N/A" + " " * 400, "<div>" * 80 + "n/a" + "</div>" * 80, "\u200b" * 500, "-" * 500):
        assert answers.is_empty(t), t
    assert not answers.is_empty("<p>" * 100 + "The town pays." + "</p>" * 100)


def test_endings():
    assert cut.ending(None) is None and cut.ending("") is None and cut.ending("All is well.") is None and cut.ending("(As I see it)") is None
    assert cut.ending("It was “a matter of taste”") is None and cut.ending("It was whole. [...]") is None
    assert cut.ending("and then it was withou…") == ("and then it was withou", True, False)
    assert cut.ending("so they began, with")[1:] == (False, False) and cut.ending("so they began,")[2]


def test_judge():
    many = {1: (50, 50, 0), 2: (40, 1, 0), 3: (9, 0, 0)}
    assert not cut.judge("table", False, False, many, 0, False, False)
    assert cut.judge("tabl", False, False, {1: (0, 0, 1)}, 12, False, False)  # a proper prefix of known words
    assert not cut.judge("zyx", False, False, {1: (0, 0, 1)}, 0, False, False) and cut.judge("zyx", False, False, {1: (0, 0, 1)}, 0, True, False)
    assert cut.judge("the", False, False, {1: (0, 900, 3), 2: (0, 80, 1)}, 40, False, False)
    assert cut.judge("table", False, False, {1: (50, 50, 0), 2: (4, 6, 0), cut.FRAME + 3: (0, 60, 0)}, 0, False, False)  # the frame never ends there


def test_quotas():
    q = {x["source"]: x for x in quotas({"a": 1000, "b": 100}, [("r", "a", 0.5, 1), ("r", "b", 0.5, 3), ("r", "none", 0.2, 9)])}
    assert q["a"]["quota"] == 300 and q["b"]["quota"] == 300 and q["b"]["copies"] == 3 and q["none"]["quota"] == 0
    assert quotas({}, [("r", "a", 1.0, 1)])[0]["quota"] == 0


@settings(max_examples=30)
@given(st.integers(0, 90), st.integers(1, 16))
def test_split_tree(n, shards):
    units = {"a": n, "b": n // 3, "c": 0}
    got = split_tree(units, shards, "seed")
    assert got == split_tree(units, shards, "seed") and {s: sum(x) for s, x in got.items()} == units
    sizes = [sum(x) for x in zip(*got.values())]
    assert len(sizes) == shards and max(sizes) - min(sizes) <= 5  # one draw of the fraction at each level


def test_rarest_segments_are_enough_and_disjoint():
    from corpusloom.llm.overlap import Q, rarest

    rng = random.Random(1)
    ns = np.array([20, 50, 51, 73, 120, 260])
    freq = [np.array([rng.choice([0, 1, 3, 500, 60000]) for _ in range(n - Q + 1)], np.uint16) for n in ns]
    first = np.concatenate([[0], np.cumsum(ns - Q + 1)])[:-1]
    for n, f, starts in zip(ns, freq, rarest(np.concatenate(freq), first, ns)):
        assert len(starts) == n // 5 + 1 and (np.diff(starts) >= Q).all() and starts[-1] <= n - Q
        assert f[starts].sum() <= min(np.sort(f[way::Q])[: n // 5 + 1].sum() for way in range(Q) if len(f[way::Q]) > n // 5)


def test_blocks_come_back_as_they_were():
    from corpusloom.llm.overlap import pack, unpack

    rng = np.random.default_rng(3)
    ref, ns = np.array([5, 1 << 40, (1 << 40) + 1]), np.array([50, 70000, 60])
    h, doc, pos = np.sort(rng.integers(0, 1 << 32, 100).astype(np.uint64)), rng.integers(0, 3, 100), rng.integers(0, 70000, 100)
    bits = rng.integers(0, 1 << 63, (3, 2)).astype(np.uint64)
    got = unpack(pack(h, doc, pos, ref, ns, bits))
    assert all((a == b).all() for a, b in zip(got, (h, doc, pos, ref, ns, bits)))


def test_members_by_bitmap_and_by_join(spark):
    from pyspark.sql import functions as F

    from corpusloom.llm.bits import marked, only_members

    rows = spark.range(3000).select(F.col("id").alias("x"), (F.col("id") % 7).alias("y"))
    wanted = spark.range(0, 3000, 10).select(F.col("id").alias("x"))
    for most in (28, 4):  # the second is too small, so a join
        assert {r["x"] for r in only_members(rows, "x", wanted, most).collect()} >= set(range(0, 3000, 10))
        got = {r["x"]: r["marked"] for r in marked(rows, "x", wanted, most).collect()}
        assert len(got) == 3000 and all(got[i] for i in range(0, 3000, 10)) and sum(got.values()) < 600
