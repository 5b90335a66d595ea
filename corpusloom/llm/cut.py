"""Texts that were cut off: ending inside a word or inside a sentence whose rest was lost.

A text that ends with a full stop, a closing quotation or the like is whole. Every other one is a candidate, and its
last words are held against the whole corpus:
- the trie of the corpus vocabulary, kept as a table of its nodes (prefixes) with the number of word tokens below each:
  a final token that is no word elsewhere and a proper prefix of known words was cut inside a word;
- contexts: how often the last 1 to 8 words stand, elsewhere, before the end of a sentence or line, before another
  word, or at the open end of a text. The longest context that is known says whether a phrase ends there;
- frames: how often a sentence ends just 1 to 8 words after a pair of words. Where a pair is never followed by an end at
  that distance ("depends on ..."), the sentence had to go on;
- neighbours: the candidate's text, sorted among the texts that begin alike, stands at the start of a longer one;
- length: how many candidates of the table have just this length, against lengths nearby (a spike is a field limit).

Words, contexts and nodes are counted over all texts. Workers look up candidates' hashes in a bitmap sized by their
number, so only counts that some candidate may need are shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.keys import key, stripped, text_records
from corpusloom.llm.answers import is_copy, is_empty, is_refusal
from corpusloom.llm.bits import LEAST_PER, bitmap_has, bits_for, bits_of, gather
from corpusloom.llm.words import INVISIBLE, LOOK_ALIKES, TAG, mixed
from corpusloom.session import table, written

LONGEST = 8
#: Words between a pair and the end; such counts carry FRAME + gap in place of the number of tokens.
GAPS, FRAME = range(1, 9), 100
#: A bitmap has 64 MB at most, whatever the input; more candidates are counted in rounds.
BITMAP_BITS = 29
#: Characters by which texts that begin alike are put together.
HEAD = 120
TOKEN = re.compile(r"\w+|[.!?…]+|\n+|[,;:]")
#: Marks put where a text was cut.
MARK = re.compile(r"(?:\s*(?:[\[(<{]\s*(?:\.{2,}|…|truncated|cut(?: off)?|continued|cont\.?|more|snip|abridged|text (?:cut|truncated)[^\])>}]{0,20})\s*[\])>}]|…|\.{3,}|�+|(?:read|show|see) more|>>+|»))+\s*$", re.I)
_SPACE = " \t\r\n\v\f  -​  　"
_END = re.compile(r"[.!?。！？]['\"”’»“)\]}*_`]*$")
_OPEN = ",;:([{«„-–—/&+'’"
START, DIGITS, COMMA, END = 0, 1, 2, 3
_MUL = np.uint64(0x9E3779B97F4A7C15)


def lightly(text: str) -> str:
    """The text without mark-up and invisible characters, look-alikes as Latin; punctuation and case stay."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFC", text)).translate(LOOK_ALIKES)
    return text


class Codes(dict):
    """token -> code: a hash for words; boundaries, numbers and commas have codes of their own."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        c = token[0]
        if c in ".!?…\n":
            v = START
        elif c in ",;:":
            v = COMMA
        elif c.isdigit():
            v = DIGITS
        else:
            v = zlib.crc32(token.encode("utf-8", "replace")) | (1 << 33)
        self[token] = v
        return v


def _step(h: np.ndarray, token: np.ndarray) -> np.ndarray:
    h = (h + token + np.uint64(7)) * _MUL
    return h ^ (h >> np.uint64(29))


def _frame(pair: np.ndarray, gap: int) -> np.ndarray:
    return mixed(pair + np.uint64(gap * 0xD1B54A32D192ED03 % (1 << 64)))


def _node(prefix: str) -> int:
    """The hash of a node of the trie."""
    return int(mixed(np.array([zlib.crc32(prefix.encode("utf-8", "replace")) | (len(prefix) << 40) | (1 << 62)], np.uint64))[0])


def _without_end(text: str) -> str:
    """The text without the blanks, invisible characters, tags and blank entities at its end, however many they are."""
    end = len(text)
    while end:
        c = text[end - 1]
        if c.isspace() or c in _SPACE or (INVISIBLE.fullmatch(c) and not unicodedata.combining(c)):
            end -= 1
            continue
        begin = text.rfind("<" if c == ">" else "&", max(0, end - 400), end) if c in ">;" else -1
        if begin < 0 or not (TAG.fullmatch(text, begin, end) if c == ">" else not INVISIBLE.sub("", html.unescape(text[begin:end])).strip()):
            break
        end = begin
    return text[:end]


def ending(text: str | None) -> tuple[str, bool, bool] | None:
    """For a candidate: the text up to its mark, whether it has a mark, and whether it ends where no sentence can; else None."""
    if not text:
        return None
    if len(text) > 400:
        text = _without_end(text)
    end = text[-40:].rstrip()
    if end[-1:] in (".", "!", "?") and end[-2:-1].isalnum():
        return None
    tail = lightly(text[-400:]).strip() if len(text) > 400 else lightly(text).strip()
    m = MARK.search(tail)
    marked = m is not None
    core = (tail[: m.start()] if m else tail).rstrip()
    if not core or _END.search(core):
        return None
    last = core[-1]
    if last.isalnum():
        return core, marked, False
    if last in _OPEN:
        # a closing apostrophe may end a word as well as a quotation
        return core, marked, last not in "'’"
    return (core, True, False) if marked and last in "\"”" else None


def last_context(core: str) -> tuple[str, list[int]]:
    """The last word (in lower case), the hashes of its contexts of 1 to LONGEST tokens within the sentence (0 for none), and of its frames."""
    tokens = TOKEN.findall(core.lower())
    while tokens and tokens[-1][0] in ",;:":
        tokens.pop()
    if not tokens or tokens[-1][0] in ".!?…\n":
        return "", []
    codes = Codes()
    arr = [START] + [codes[t] for t in tokens]
    out, h = [], np.zeros(1, np.uint64)
    for c in reversed(arr[-LONGEST:]):
        h = _step(h, np.array([c], np.uint64))
        out.append(int(mixed(h)[0]))
        if c == START:
            break
    out += [0] * (LONGEST - len(out))
    for gap in GAPS:
        k = len(arr) - 1 - gap
        if k < 1 or START in arr[k:]:
            break
        pair = _step(_step(np.zeros(1, np.uint64), np.array([arr[k]], np.uint64)), np.array([arr[k - 1]], np.uint64))
        out += [int(_frame(pair, gap)[0]), int(_frame(pair, 0)[0])]
    return tokens[-1], out


_CANDIDATE = "tbl string, id string, at timestamp, source string, model string, length int, marked boolean, hard boolean, word string, node bigint, hs array<bigint>, head bigint, core string, text string, prompt string, src string"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _uncut(text: str) -> str:
    """The text as it is counted: without a mark at its end, so that a cut text's last word stands at an open end."""
    text = lightly(text).rstrip(_SPACE)
    if text[-1:] not in "])}>…�»" and not text.endswith("..") and text[-4:].lower() != "more":
        return text  # no mark ends otherwise
    return text[:-60] + MARK.sub("", text[-60:]) if MARK.search(text[-60:]) else text


_TO_BLANK = str.maketrans({chr(i): " " for i in range(128) if not (chr(i).isalnum() or chr(i) in "_.!?\n,;:")})
_APART = ".!?\n,;:"


def _tokens(text: str) -> list[str]:
    """The tokens of a text in lower case, as TOKEN finds them but for runs of marks, which count alike one by one."""
    text = text.lower()
    if not text.isascii():
        return TOKEN.findall(text)
    text = text.translate(_TO_BLANK)
    for c in _APART:
        if c in text:
            text = text.replace(c, f" {c if c != chr(10) else '.'} ")
    return text.split()


def _head(text: str) -> int:
    return _signed(int.from_bytes(zlib.crc32(text[:HEAD].encode("utf-8", "replace")).to_bytes(4, "big") + b"head", "big"))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tbl", pa.string()), ("id", pa.string()), ("at", pa.timestamp("us", "UTC")), ("source", pa.string()), ("model", pa.string()), ("length", pa.int32()), ("marked", pa.bool_()), ("hard", pa.bool_()), ("word", pa.string()), ("node", pa.int64()), ("hs", pa.list_(pa.int64())), ("head", pa.int64()), ("core", pa.string()), ("text", pa.string()), ("prompt", pa.string()), ("src", pa.string())])
    for batch in batches:
        found = [(i, t, e) for i, t in enumerate(batch.column("text").to_pylist()) if (e := ending(t)) is not None]
        rows = [[] for _ in schema]
        for i, text, (core, marked, hard) in found:
            if is_empty(text) or is_refusal(text):
                continue
            word, hs = last_context(core)
            if not hs:
                continue
            row = {n: batch.column(n)[i].as_py() for n in ("tbl", "id", "at", "source", "model", "prompt", "src")}
            if row["tbl"] == "ai_texts" and is_copy(text, None, row["prompt"]):
                continue
            row |= {"length": len(text), "marked": marked, "hard": hard, "word": word, "node": _signed(_node(word)), "hs": [_signed(h) for h in hs], "head": _head(text), "core": text[: text.rfind(core[-20:]) + len(core[-20:])] if core[-20:] in text else text, "text": text if row["tbl"] == "rewritten_texts" else None}
            for c, n in zip(rows, schema.names, strict=True):
                c.append(row[n])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)


def _count(cells, bits: int):
    """Partial counts (h, e, m, o): before an end, before a word, at a text's open end; for nodes of the trie m counts tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        wanted: dict[str, list[int]] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                seen: Counter = Counter()
                parts = [np.array([END], np.uint64)]
                for text in batch.column("text").slice(begin, 2000).to_pylist():
                    if text:
                        tokens = _tokens(_uncut(text))
                        seen.update(tokens)
                        parts += [np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens)), np.array([END], np.uint64)]
                a = np.concatenate(parts)
                is_word = (a == DIGITS) | (a > 1 << 32)
                p = np.flatnonzero(is_word[:-1])
                after = a[p + 1]
                # a text's last token has no token after it; one that ends in a full stop has that
                kind = np.where(after == START, 0, np.where(after == END, 2, 1)).astype(np.int8)
                h, got = np.zeros(len(p), np.uint64), []
                for j in range(LONGEST):
                    if not len(p):
                        break
                    token = a[p - j]
                    stop = (token == START) | (token == END)
                    h = _step(h, np.where(stop, np.uint64(START), token))
                    full = mixed(h)
                    has = bitmap_has(cells.value, bits, full)
                    got.append((full[has], kind[has]))
                    go = has & ~stop
                    p, h, kind = p[go], h[go], kind[go]
                pair = _step(_step(np.zeros(len(a) - 1, np.uint64), a[1:]), np.where(a[:-1] == END, np.uint64(START), a[:-1]))
                at2 = np.flatnonzero((a[1:] != START) & (a[1:] != END)) + 1
                at2 = at2[bitmap_has(cells.value, bits, _frame(pair[at2 - 1], 0))]
                for gap in GAPS:
                    # the pair ends at at2, the sentence at most gap words later; drop those that end before
                    at2 = at2[at2 + gap < len(a) - 1]
                    last = a[at2 + gap]
                    at2 = at2[(last != START) & (last != END)]
                    ends = at2[(a[at2 + gap] == DIGITS) | (a[at2 + gap] > 1 << 32)]
                    full = _frame(pair[ends - 1], gap)
                    has = bitmap_has(cells.value, bits, full)
                    nxt = a[ends[has] + gap + 1]
                    got.append((full[has], np.where(nxt == START, 0, np.where(nxt == END, 2, 1)).astype(np.int8)))
                hs = np.concatenate([x for x, _ in got]) if got else np.empty(0, np.uint64)
                ks = np.concatenate([x for _, x in got]) if got else np.empty(0, np.int8)
                # the two lowest bits of a hash make room for the kind, so that one sort counts them all
                u, c = np.unique((hs & ~np.uint64(3)) | ks.astype(np.uint64), return_counts=True)
                k3 = u & np.uint64(3)
                u = u & ~np.uint64(3)
                n = [np.where(k3 == k, c, 0).astype(np.int64) for k in range(3)]
                below: Counter = Counter()
                for token, times in seen.items():
                    if not token[0].isalpha():
                        continue
                    nodes = wanted.get(token)
                    if nodes is None:
                        if len(wanted) > 1 << 18:
                            wanted.clear()
                        every = np.array([_node(token[:i]) for i in range(1, len(token))], np.uint64)
                        nodes = wanted[token] = every[bitmap_has(cells.value, bits, every)].tolist() if len(every) else []
                    for x in nodes:
                        below[x] += times
                bh, bn = np.fromiter(below.keys(), np.uint64, len(below)), np.fromiter(below.values(), np.int64, len(below))
                zero = np.zeros(len(bh), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((u.view(np.int64), (bh & ~np.uint64(3)).view(np.int64)), (n[0], zero), (n[1], bn), (n[2], zero))], ["h", "e", "m", "o"])

    return run


def judge(word: str, marked: bool, hard: bool, seen: dict[int, tuple[int, int, int]], below: int, spike: bool, longer: bool) -> bool:
    """Whether the candidate was cut: seen has (end, mid, open) of its contexts by their tokens, and of its frames."""
    if hard or longer:
        return True
    doubt = marked or spike
    e1, m1, o1 = seen.get(1, (0, 0, 0))
    known = e1 + m1
    if word[0].isalpha() and known == 0:
        return below > 0 or (doubt and o1 < 3)
    contexts = [(j, *seen[j]) for j in range(LONGEST, 0, -1) if j in seen]
    for j, e, m, o in contexts:
        if j >= 3 and o >= 4 and o > 3 * (e + m):
            return False  # a closing line that many texts share
    deeper = [(e, m) for j, e, m, _ in contexts if j >= 2 and e + m > 0]
    if word[0].isalpha() and not deeper and below > 20 * known:
        return True
    # does a phrase end here? the longest context that came three times, else the longest that came at all
    e, m = next((x for x in deeper if sum(x) >= 3), deeper[0] if deeper else (e1, m1))
    if e == 0 or e < 0.05 * (e + m):
        return True
    if deeper and (e >= 3 and m == 0 or e >= 5 and e >= 0.9 * (e + m)):
        return False
    # may the sentence end here? the frame least often ended at this distance
    frames = [seen[FRAME + g] for g in GAPS if FRAME + g in seen]
    least = min((f[0] / (f[0] + f[1]) for f in frames if f[0] + f[1] >= 25), default=None)
    if least is not None:
        return least < (0.04 if doubt else 0.02)
    return e < m or (doubt and e == m)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            r = {n: batch.column(n)[i].as_py() for n in ("word", "marked", "hard", "seen", "below", "spike", "longer", "text", "prompt", "original")}
            seen = {s["j"]: (s["e"], s["m"], s["o"]) for s in r["seen"]}
            cut = judge(r["word"], r["marked"], r["hard"], seen, r["below"], r["spike"], r["longer"])
            keep.append(cut and not (r["text"] is not None and is_copy(r["text"], r["original"], r["prompt"])))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["tbl", "id", "at", "source", "model", "length", "marked"])


def candidates(recs: DataFrame) -> DataFrame:
    """Records whose text doesn't end as a whole text does; not empty, not a refusal, not a copy of their prompt."""
    return recs.where("id is not null and text is not null").mapInArrow(_candidates, _CANDIDATE)


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        half = (low + high) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half)
    return low


def _outgrown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines sorted from the end: the cores at the start of a text that is more than 30 characters longer (kind found).

    A line still to come can only be a beginning of the last one read, so of the texts read the longest is kept for each
    length of their common beginning with that line; a hot beginning needs no more than this. Where the sort goes on in
    the partition before, a core is open if it begins this partition's first line: only then can a text there start with
    it. For those, the beginnings kept at the end stand for the partition's texts (kind text, with the longest's size).
    """
    top = last = None
    longest: list[tuple[int, int]] = []  # (common beginning with last, length of the longest such text), rising in the first
    for batch in batches:
        out: list[tuple[str, str, int]] = []
        for line, size, is_text in zip(*(batch.column(c).to_pylist() for c in ("line", "size", "is_text")), strict=True):
            if top is None:
                top = last = line
            n, common, most = len(line), _common(last, line), 0
            while longest and longest[-1][0] >= common:
                most = max(most, longest.pop()[1])
            if most:
                longest.append((common, most))
            most = longest[-1][1] if longest and longest[-1][0] == n else 0
            if is_text:
                if most:
                    longest.pop()
                longest.append((n, max(size, most)))
            elif most > n + 30:
                out.append(("found", line, n))
            elif top.startswith(line):
                out.append(("open", line, n))
            last = line
        yield _kinds(out)
    if last is not None:
        most, out = 0, []
        for n, size in reversed(longest):  # a shorter beginning with no longer text says nothing more
            if size > most:
                out.append(("text", last[:n], size))
                most = size
        yield _kinds(out)


def _kinds(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], ["kind", "line", "size"])


def _longer_neighbours(cand: DataFrame, recs: DataFrame) -> DataFrame:
    """core of candidates whose text is the beginning of another text, seen by sorting cores among texts that begin alike.

    The sort is by ranges of lines, so texts that share an opening are spread over tasks however many they are.
    """
    asked = cand.where(F.length("core") >= HEAD).select("head", F.col("core").alias("line")).distinct()
    heads = asked.select("head").distinct()
    bits = bits_of(heads.count())
    found = gather(heads, lambda b: mixed(b.column("head").to_numpy().view(np.uint64)), bitmap=bits)[0] if bits else None
    cells = cand.sparkSession.sparkContext.broadcast(found)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if t]
            if texts and cells.value is not None:  # with too many heads for a bitmap all texts are sorted
                hs = np.array([_head(t) for t in texts], np.int64)
                texts = [texts[i] for i in np.flatnonzero(bitmap_has(cells.value, bits, mixed(hs.view(np.uint64))))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["line"])

    texts = recs.select("text").mapInArrow(alike, "line string").distinct()
    size = F.length("line").alias("size")
    both = written(texts.select("line", size, F.lit(1).alias("is_text")).unionByName(asked.select("line", size, F.lit(0).alias("is_text"))), "lines")
    schema = "kind string, line string, size int"
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = written(both.repartitionByRange(tasks, F.desc("line")).sortWithinPartitions(F.desc("line")).mapInArrow(_outgrown, schema), "neighbours")
    # what lies across the ends of partitions: a few lines of each
    ends = seen.where("kind <> 'found'").select("line", "size", F.when(F.col("kind") == "text", 1).otherwise(0).alias("is_text")).distinct()
    across = ends.repartition(1).sortWithinPartitions(F.desc("line"), F.desc("is_text")).mapInArrow(_outgrown, schema)
    return seen.unionByName(across).where("kind = 'found'").select(F.col("line").alias("core")).distinct()


def _evidence(cand: DataFrame, recs: DataFrame, bits: int) -> DataFrame:
    """tbl, id, at, seen (counts of the candidate's contexts and frames) and below (tokens below its node of the trie)."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([batch.column("hs").flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("node").to_numpy()]).view(np.uint64)

    cells, _ = gather(cand.select("hs", "node"), hashes, bitmap=bits)
    counts = recs.select("text").mapInArrow(_count(cand.sparkSession.sparkContext.broadcast(cells), bits), "h bigint, e bigint, m bigint, o bigint").groupBy("h").agg(*[F.sum(c).alias(c) for c in "emo"])
    # positions in hs: LONGEST contexts, then for each gap its frame and the frame's pair, which only serves to look up
    place = F.when(F.col("p") < LONGEST, F.col("p") + 1).when((F.col("p") - LONGEST) % 2 == 0, FRAME + 1 + ((F.col("p") - LONGEST) / 2).cast("int"))
    asked = cand.select("tbl", "id", "at", F.posexplode("hs").alias("p", "h")).select("tbl", "id", "at", place.alias("j"), F.col("h").bitwiseAND(F.lit(-4).cast("bigint")).alias("h")).where("h <> 0 and j is not null").unionByName(cand.select("tbl", "id", "at", F.lit(-1).alias("j"), F.col("node").bitwiseAND(F.lit(-4).cast("bigint")).alias("h")))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return asked.join(counts, "h", "left").groupBy("tbl", "id", "at").agg(F.collect_list(F.when(F.col("j") >= 0, F.struct("j", n("e"), n("m"), n("o")))).alias("seen"), F.coalesce(F.max(F.when(F.col("j") < 0, F.col("m"))), F.lit(0)).alias("below"))


def truncated(recs: DataFrame, originals: DataFrame) -> DataFrame:
    """tbl, id, at, source, model, length and marked of each record whose text was cut off.

    recs: tbl, id, at, text, source, model, prompt, src; originals: k, at, text (what rewritten records are copies of, if
    they are). Null and empty texts, refusals and copies are no cases; a record with a null id is left out. A key that
    came more than once counts as it came first. Texts of any length are read whole; an empty table gives no rows.
    """
    cand = written(candidates(recs), "candidates")
    # as many rounds as bitmaps of bounded size ask for; each counts what its candidates may need
    asked = cand.select(F.explode(F.concat("hs", F.array("node"))).alias("h")).agg(F.approx_count_distinct("h", 0.02)).first()[0]
    rounds = max(1, -(-int(1.1 * asked) * LEAST_PER >> BITMAP_BITS))
    part = F.pmod(F.xxhash64("id"), F.lit(rounds))
    seen = reduce(DataFrame.unionByName, [_evidence(cand.where(part == i) if rounds > 1 else cand, recs, bits_for(int(1.1 * asked / rounds), BITMAP_BITS)) for i in range(rounds)])
    # a spike: the candidates of this length in the table against the mean of the 20 lengths on either side
    by_length = cand.groupBy("tbl", "length").agg(F.count("*").alias("c"))
    around = W.partitionBy("tbl").orderBy("length").rangeBetween(-20, 20)
    spikes = by_length.select("tbl", "length", ((F.col("c") >= 4) & (F.col("c") > 3 * (F.sum("c").over(around) - F.col("c")) / 20)).alias("spike")).where("spike")
    longer = _longer_neighbours(cand, recs).withColumn("longer", F.lit(True))  # cores are distinct
    src = cand.where("text is not null and src is not null").select("src").distinct()
    orig = originals.join(src, originals["k"] == src["src"], "left_semi").groupBy("k").agg(F.min(F.struct("at", "text"))["text"].alias("original"))
    whole = cand.drop("hs", "node").join(seen, ["tbl", "id", "at"]).join(spikes, ["tbl", "length"], "left").join(longer, "core", "left").join(orig, F.when(F.col("text").isNotNull(), F.col("src")) == orig["k"], "left")
    whole = whole.withColumns({"spike": F.coalesce("spike", F.lit(False)), "longer": F.coalesce("longer", F.lit(False))})
    cols = ["tbl", "id", "at", "source", "model", "length", "marked", "word", "hard", "seen", "below", "spike", "longer", "text", "prompt", "original"]
    found = whole.select(cols).mapInArrow(_judged, "tbl string, id string, at timestamp, source string, model string, length int, marked boolean")
    firsts = recs.select(key("id").alias("k"), "at").where("k is not null").groupBy("k").agg(F.min("at").alias("first"))
    return found.join(firsts, (key("id") == F.col("k")) & F.col("at").eqNullSafe(F.col("first"))).drop("k", "first").distinct()


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_records(spark, sf_dir, ["id", "text", "source", "model", "prompt", "source_text_id", "ingested_at"])
    return rows.select("tbl", stripped("id").alias("id"), F.col("ingested_at").alias("at"), "text", key("source").alias("source"), stripped("model").alias("model"), "prompt", key("source_text_id").alias("src"))


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "human_texts").select(key("id").alias("k"), F.col("ingested_at").alias("at"), "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(records(spark, sf_dir), originals(spark, sf_dir)).select("id").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, source and model: records, truncated ones, those with a mark, and the share."""
    recs = records(spark, sf_dir)
    cut = truncated(recs, originals(spark, sf_dir)).select(key("id").alias("k"), "marked").dropDuplicates(["k"])
    every = recs.select("tbl", "source", "model", key("id").alias("k")).where("k is not null").dropDuplicates(["k"])
    n = every.join(cut, "k", "left").groupBy("tbl", "source", "model").agg(F.count("*").alias("n_records"), F.count("marked").alias("n_truncated"), F.count(F.when(F.col("marked"), 1)).alias("n_marked"))
    return n.withColumn("share", F.round(F.col("n_truncated") / F.col("n_records"), 6))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
SQL: dict[str, str] = {}
