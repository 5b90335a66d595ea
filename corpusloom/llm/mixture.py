"""Mixing sources to target weights, exactly, and dealing the mixture to output shards.

How much: of each recipe the total is the largest at which every source that has tokens can reach its share without a
document being used more than max_repeats times; sources without tokens are left out and the shares of the others kept
in proportion. A source of size S with quota Q gives floor(Q/S) whole copies of all its documents and a part of them once
more.

Which: the documents of a source are permuted by a hash and cut into blocks, by the first bits of it. Block sizes are
added up in the order of the hash; a source's quota is so many whole blocks, and one that is cut at a document where the
tokens wanted are reached. A block of a further copy is a block of its own in the quota.

Where: a splitting tree divides the block quotas between the shards. At each node the left half of the shards gets its
exact number of blocks, drawn without replacement from those of all sources (multivariate hypergeometric), the right half
the others. A leaf so knows how many blocks of each source are its own; it draws them, disjoint from other leaves', as the
next of the source's permuted blocks, and shuffles their documents by a hash of its own. A document is in the mixture as
often as shards have drawn it. What the driver holds and broadcasts is a row for each source of a recipe with a number for
each shard, however many blocks, copies or documents there are. Only blocks that are cut are sorted.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.keys import key
from corpusloom.llm.encode import TOKENIZERS, VOCABULARY, token_counts
from corpusloom.session import table, written

#: Documents a block has on average, and the most blocks of a source (the driver sees one number for each).
BLOCK_DOCS, MOST_BLOCKS = 2_000, 4_096
SHARDS = 16


def sized(docs: DataFrame, *, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (as compared) and n_tokens of each document with an id, a source and at least one token; written once."""
    rows = docs.select("doc_id", key("source").alias("source"), "text").where("doc_id is not null and source is not null and text is not null")
    return written(token_counts(rows, folder=folder, vocabulary=vocabulary).where("n_tokens > 0").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")), "sized")


def _blocks(docs: DataFrame, seed: str) -> tuple[DataFrame, int]:
    """docs with h (its place in the permutation, 0 <= h < 2**32) and block; and the number of blocks of a source."""
    most = docs.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n = min(MOST_BLOCKS, 1 << max(6, math.ceil(math.log2(max(1, most / BLOCK_DOCS)))))
    h = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 32))
    return docs.withColumn("h", h).withColumn("block", F.floor(F.col("h") * n / (1 << 32)).cast("int")), n


def quotas(sizes: dict[str, int], targets: list[tuple[str, str, float, int]]) -> list[dict]:
    """Per recipe and source: target and reachable share, quota in tokens, whole copies and tokens of the part.

    sizes: tokens by source; targets: (recipe, source, target_share, max_repeats).
    """
    out = []
    for recipe in sorted({t[0] for t in targets}):
        own = [t for t in targets if t[0] == recipe]
        usable = [t for t in own if sizes.get(t[1], 0) > 0 and t[2] > 0 and t[3] > 0]
        share = sum(t[2] for t in usable)
        total = min((sizes[t[1]] * t[3] * share / t[2] for t in usable), default=0.0)
        for _, source, target, repeats in own:
            size = sizes.get(source, 0)
            quota = min(round(total * target / share), size * repeats) if (recipe, source, target, repeats) in usable else 0
            out.append({"recipe": recipe, "source": source, "target_share": target, "max_repeats": repeats, "source_tokens": size, "quota": quota, "copies": quota // size if size else 0, "part": quota % size if size else 0})
    return out


def split_tree(units: dict[str, int], shards: int, seed: str) -> dict[str, list[int]]:
    """How many of each source's blocks each shard gets: multivariate hypergeometric draws down a tree of halves."""
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=8).digest(), "big"))
    names = sorted(units)
    out: dict[str, list[int]] = {s: [] for s in names}

    def node(own: np.ndarray, n: int) -> None:
        if n == 1:
            for s, x in zip(names, own.tolist(), strict=True):
                out[s].append(x)
            return
        left, total = n // 2, int(own.sum())
        # the left half's share of the blocks; of the fractional one the draw decides
        k, rest = divmod(total * left, n)
        drawn = rng.multivariate_hypergeometric(own, k + int(rng.random() < rest / n), method="marginals")
        node(drawn, left)
        node(own - drawn, n - left)

    if names:
        node(np.array([units[s] for s in names], np.int64), shards)
    return out


def _plan(docs: DataFrame, targets: DataFrame, seed: str, shards: int) -> tuple[DataFrame, list[tuple]]:
    """docs of the sources named, with h and block; and for each recipe and source: n_blocks, copies, full, wanted, bounds.

    Each document comes `copies` times; once more in the blocks below `full`, and in block `full` up to `wanted` tokens.
    Of the blocks in their order, copy by copy, shard i draws those from bounds[i - 1] on, before bounds[i].
    """
    docs, n_blocks = _blocks(docs.select("doc_id", "source", "n_tokens"), seed)
    # at most MOST_BLOCKS rows for each source of the targets; sources that no recipe names aren't gathered
    rows = [(r["recipe"], r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("recipe", key("source").alias("source"), "target_share", "max_repeats").where("recipe is not null and source is not null").distinct().collect()]
    named = docs.where(F.col("source").isin(sorted({r[1] for r in rows})))
    blocks: dict[str, list[tuple[int, int]]] = {}
    for r in named.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).orderBy("source", "block").collect():
        blocks.setdefault(r["source"], []).append((r["block"], r["n"]))
    plan, units = [], {}
    for q in quotas({s: sum(n for _, n in b) for s, b in blocks.items()}, rows):
        if not q["quota"]:
            continue
        left, full, wanted = q["part"], 0, 0
        for block, n in blocks[q["source"]]:
            if n > left:
                full, wanted = block, left
                break
            left -= n
        plan.append((q["recipe"], q["source"], n_blocks, q["copies"], full, wanted))
        units.setdefault(q["recipe"], {})[q["source"]] = n_blocks * q["copies"] + full + (wanted > 0)
    drawn = {r: split_tree(u, shards, f"{seed}:{r}") for r, u in units.items()}
    return named, [(*p, np.cumsum(drawn[p[0]][p[1]]).tolist()) for p in plan]


def mixture(docs: DataFrame, targets: DataFrame, *, seed: str = "42", shards: int = SHARDS) -> DataFrame:
    """recipe, source, doc_id, n_tokens and, of every chosen document, the shards that its copies are in (an array).

    docs: doc_id, source, n_tokens (as sized() gives them: one row a document, at least one token); targets: recipe,
    source, target_share, max_repeats. No document has more than max_repeats copies in a recipe. The part of a source
    stops at the document with which its quota is reached or, if that is nearer, at the one before. Sources without
    documents, shares of 0 and unknown sources give no rows; empty tables give none.
    """
    named, plan = _plan(docs, targets, seed, shards)
    plan_df = named.sparkSession.createDataFrame(plan, "recipe string, source string, n_blocks int, copies int, full int, wanted bigint, bounds array<bigint>")
    rows = named.join(F.broadcast(plan_df), "source")  # a row for each row of the targets
    whole = rows.where("block <> full or wanted = 0").withColumn("repeats", F.col("copies") + (F.col("block") < F.col("full")).cast("int"))
    # the block that is cut: up to the document after which the tokens are nearest to those wanted
    before = F.sum("n_tokens").over(W.partitionBy("recipe", "source").orderBy("h", "doc_id")) - F.col("n_tokens")
    cut = rows.where("block = full and wanted > 0").withColumn("repeats", F.col("copies") + (before + F.col("n_tokens") / 2 < F.col("wanted")).cast("int"))
    # the shard of a copy: of its block's place among the blocks drawn; a place past the last bound is in no shard
    place = lambda c: (c.cast("bigint") - 1) * F.col("n_blocks") + F.col("block")
    shard = lambda c: F.size(F.filter("bounds", lambda b: b <= place(c)))
    drawn = F.filter(F.transform(F.sequence(F.lit(1), F.col("repeats")), shard), lambda x: x < shards)
    return whole.unionByName(cut).where("repeats > 0").select("recipe", "source", "doc_id", "n_tokens", drawn.alias("shards"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recipe, source, doc_id, n_tokens and repeats of every chosen document."""
    return mixture(*_inputs(spark, sf_dir)).select("recipe", "source", "doc_id", "n_tokens", F.size("shards").alias("repeats"))


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(*_inputs(spark, sf_dir)).select("recipe", "source", "doc_id", "n_tokens", F.posexplode("shards").alias("copy", "shard")).withColumn("copy", F.col("copy") + 1)


def p7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy with its shard and its place there (rows of a shard sorted by place are its shuffled order)."""
    return _copies(spark, sf_dir).select("recipe", "source", "doc_id", "copy", "shard", F.xxhash64(F.lit("42"), "shard", "doc_id", "copy").alias("place"))


def p7_shard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recipe, shard and source: copies, tokens, and their share of the shard's."""
    got = _copies(spark, sf_dir).groupBy("recipe", "shard", "source").agg(F.count("*").alias("n_copies"), F.sum("n_tokens").alias("n_tokens"))
    return got.withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(W.partitionBy("recipe", "shard")))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recipe and source of the targets: target and actual share of all tokens, tokens, documents, most repeats."""
    docs, targets = _inputs(spark, sf_dir)
    repeats = F.size("shards")
    got = mixture(docs, targets).groupBy("recipe", "source").agg(F.sum(F.col("n_tokens") * repeats).alias("n_tokens"), F.sum(repeats).alias("n_copies"), F.max(repeats).alias("most_repeats"))
    want = targets.select("recipe", key("source").alias("source"), "target_share", "max_repeats").distinct()
    out = want.join(got, ["recipe", "source"], "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    return out.select("recipe", "source", "target_share", (F.col("n_tokens") / F.sum("n_tokens").over(W.partitionBy("recipe"))).alias("actual_share"), "n_tokens", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))


QUERIES = {"p7_mix": p7_mix, "p7_shards": p7_shards, "p7_shard_report": p7_shard_report, "p7_report": p7_report}
SQL: dict[str, str] = {}
