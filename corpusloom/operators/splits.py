"""Splits in an order by md5, group splits, components of records that share a text, and checks for leakage.

Ranks over all rows come from bucket counts (see corpus.with_global_rank), so no window holds a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.operators.components import contract
from corpusloom.operators.corpus import CORPUS, corpus, with_global_rank
from corpusloom.session import written

_W = f"with {CORPUS}"


def ordered(df: DataFrame, k: str, seed: str = "42", part: list[str] | None = None) -> DataFrame:
    """df with r, the 1-based rank of column k in the order of md5(seed:k), and n, the number of rows (of the part)."""
    part = part or []
    rows = df.withColumn("_h", F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.col(k))), F.col(k)))
    ranked = with_global_rank(rows, "_h", "r", part=part).drop("_h")
    if not part:
        return ranked.withColumn("n", F.lit(df.count()))
    n = df.groupBy(*part).agg(F.count("*").alias("n"))
    return ranked.join(n, [ranked[c].eqNullSafe(n[c]) for c in part]).drop(*[n[c] for c in part])


def truncated_shares(train: float = 0.70, val: float = 0.15) -> F.Column:
    """train, val or test by rank: the first int(n * train), the next int(n * val), the rest."""
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    return F.when(F.col("r") <= a, "train").when(F.col("r") <= a + b, "val").otherwise("test")


def rounded_shares(train: float = 0.70, val: float = 0.15) -> F.Column:
    """The same with half-even rounding of the sizes."""
    a, b = F.bround(F.col("n") * train), F.bround(F.col("n") * val)
    return F.when(F.col("r") <= a, "train").when(F.col("r") <= a + b, "val").otherwise("test")


def record_split(spark, d):
    """HC3 records, each by itself: this can separate answers to one prompt."""
    c = corpus(spark, d, ["source"]).where("source = 'hc3'").select("k")
    return ordered(c, "k").select(F.col("k").alias("id"), truncated_shares().alias("new_split"))


def author_disjoint_split(spark, d):
    """Authors are split as wholes, records without an author one by one."""
    c = corpus(spark, d, ["author_id"])
    units = c.select(F.col("author_id").isNotNull().alias("known"), F.coalesce("author_id", "k").alias("unit")).distinct()
    s = ordered(units, "unit", part=["known"]).select("known", "unit", truncated_shares().alias("new_split"))
    return c.select("id", F.col("author_id").isNotNull().alias("known"), F.coalesce("author_id", "k").alias("unit")).join(s, ["known", "unit"]).select("id", "new_split")


def _groups(spark, d) -> DataFrame:
    """Records with their tagged group: author of essays, author of the source of rewrites, prompt of answers, else the record."""
    c = corpus(spark, d, ["source", "author_id", "src", "prompt_hash"])
    h = c.where("tbl = 'human_texts'").select(F.col("k").alias("src"), F.col("author_id").alias("src_author"))
    c = c.join(h, "src", "left")
    alone = F.concat(F.lit("one|"), "k")
    essay = F.coalesce(F.concat(F.lit("author|"), "author_id"), alone)
    of_source = F.coalesce(F.concat(F.lit("author|"), "src_author"), F.concat(F.lit("orphan|"), "k"))
    g = F.when(F.col("source") == "use", essay).when(F.col("source") == "use_rewrite", of_source).when(F.col("source") == "hc3", F.coalesce(F.concat(F.lit("prompt|"), "prompt_hash"), alone)).otherwise(alone)
    return c.select("k", "id", "source", g.alias("g"))


_G = f"""{_W}, g as (select c.k, c.id, c.source, case when c.source = 'use' then coalesce('author|' || c.author_id, 'one|' || c.k)
    when c.source = 'use_rewrite' then coalesce('author|' || h.author_id, 'orphan|' || c.k) when c.source = 'hc3' then coalesce('prompt|' || md5(c.prompt), 'one|' || c.k) else 'one|' || c.k end as g
  from corpus c left join corpus h on h.k = c.src and h.tbl = 'human_texts')"""


def group_keys(spark, d):
    return _groups(spark, d).select("id", F.col("g").alias("group_key"))


def drop_small_groups(spark, d, least=2, every=False):
    """Author groups (or, with `every`, groups of any kind) with fewer records than `least` are dropped; other groups stay."""
    g = _groups(spark, d)
    n = g.groupBy("g").agg(F.count("*").alias("n"))
    kept = F.col("n") >= least
    return g.join(n.where(kept if every else kept | ~F.col("g").startswith("author|")), "g").select("id", "n")


def drop_every_small_group(spark, d):
    return drop_small_groups(spark, d, every=True)


def _dominant(g: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """g, stratum: the most frequent source of each group, ties by name."""
    n = g.groupBy("g", "source").agg(F.count("*").alias("n"))
    return n.groupBy("g").agg(F.min_by("source", F.struct((-F.col("n")).alias("n"), "source")).alias("stratum"))


def stratified_group_split(spark, d, seed="42"):
    """Groups by dominant source, each stratum dealt 70/15/15 by groups with half-even rounding."""
    g = _groups(spark, d)
    s = ordered(_dominant(g), "g", seed, ["stratum"]).select("g", "stratum", rounded_shares().alias("new_split"))
    return g.join(s, "g").select("id", "stratum", "new_split")


def multi_seed_split(spark, d, seeds=range(5)):
    """Groups per split for each seed: the strata are formed once, only the order changes."""
    strata = written(_dominant(_groups(spark, d)), "strata")
    out = None
    for seed in seeds:
        one = ordered(strata, "g", str(seed), ["stratum"]).groupBy(F.lit(seed).alias("seed"), "stratum", rounded_shares().alias("new_split")).agg(F.count("*").alias("n"), F.min("g").alias("first_group"))
        out = one if out is None else out.unionByName(one)
    return out


def group_shuffle_split(spark, d, share=0.10):
    """A tenth of the groups (rounded up) as validation."""
    g = _groups(spark, d)
    s = ordered(g.select("g").distinct(), "g", "7").select("g", F.when(F.col("r") <= F.ceil(F.col("n") * share), "val").otherwise("train").alias("new_split"))
    return g.join(s, "g").select("id", "new_split")


def capped_per_domain(spark, d, most=600):
    """At most so many HC3 records of each domain, the first in the order of md5: a sampling operator."""
    c = corpus(spark, d, ["source", "domain"]).where("source = 'hc3'").select("k", "domain")
    return ordered(c, "k", "cap", ["domain"]).where(F.col("r") <= most).select(F.col("k").alias("id"), "domain", "r")


def text_components(spark, d):
    """Groups that share a text, chained: their number, their groups and their records by component (named by its least group)."""
    c = corpus(spark, d, ["text_hash"])
    g = _groups(spark, d).join(c.select("k", "text_hash"), "k")
    first = g.where("text_hash is not null").groupBy("text_hash").agg(F.min("g").alias("u"))
    edges = g.join(first, "text_hash").where("u <> g").select("u", F.col("g").alias("v")).distinct()
    comp, _ = contract(edges)
    named = comp.join(comp.groupBy("root").agg(F.min("label").alias("component")), "root").select(F.col("label").alias("g"), "component")
    return g.join(named, "g").groupBy("component").agg(F.countDistinct("g").alias("n_groups"), F.count("*").alias("n_records"))


def leakage_report(spark, d):
    """Distinct values of each key that stand in two splits, for each pair of splits; null keys don't count."""
    c = corpus(spark, d, ["split", "text_hash", "author_id", "prompt_hash", "src"]).where("split in ('train', 'val', 'test')")
    keys = F.array(*[F.struct(F.lit(n).alias("what"), F.col(x).cast("string").alias("value")) for n, x in (("id", "k"), ("text", "text_hash"), ("author_id", "author_id"), ("prompt", "prompt_hash"), ("source_text_id", "src"))])
    long = c.select("split", F.explode(keys).alias("e")).select("split", "e.what", "e.value").where("value is not null")
    has = [F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")]
    by = long.groupBy("what", "value").agg(*has)
    both = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}")
    return by.groupBy("what").agg(both("train", "val"), both("train", "test"), both("val", "test"))


def group_size_distribution(spark, d):
    g = _groups(spark, d).groupBy("g").agg(F.count("*").alias("size"))
    return g.groupBy("size").agg(F.count("*").alias("n_groups"))


def class_weights(spark, d):
    """total / (classes * count) by label and by source within it: inverse-frequency weights."""
    c = corpus(spark, d, ["label", "split"]).where("split = 'train'").groupBy("label").agg(F.count("*").alias("n"))
    w = W.partitionBy()  # one row for each class
    return c.select("label", "n", F.round(F.sum("n").over(w) / (F.count("*").over(w) * F.greatest("n", F.lit(1))), 6).alias("weight"))


_SHARE = "case when r <= {f}(n * 0.70::double) then 'train' when r <= {f}(n * 0.70::double) + {f}(n * 0.15::double) then 'val' else 'test' end"
_TRUNC, _ROUND = _SHARE.format(f="floor"), _SHARE.format(f="round_even0").replace("round_even0(n * 0.70::double)", "round_even(n * 0.70::double, 0)").replace("round_even0(n * 0.15::double)", "round_even(n * 0.15::double, 0)")
_STRATA = f"{_G}, m as (select g, source, count(*) as c from g group by 1, 2), st as (select g, first(source order by c desc, source nulls first) as stratum from m group by 1)"
_PAIR = lambda a, b: f"sum({a} * {b}) as {a}_{b}"
SQL = {
    "record_split": f"{_W}, o as (select k, row_number() over (order by md5('42:' || k), k) as r, count(*) over () as n from corpus where source = 'hc3') select k as id, {_TRUNC} as new_split from o",
    "author_disjoint_split": f"{_W}, u as (select distinct author_id is not null as known, coalesce(author_id, k) as unit from corpus), o as (select *, row_number() over (partition by known order by md5('42:' || unit), unit) as r, count(*) over (partition by known) as n from u) select c.id, {_TRUNC} as new_split from corpus c join o on o.known = (c.author_id is not null) and o.unit = coalesce(c.author_id, c.k)",
    "group_keys": f"{_G} select id, g as group_key from g",
    "drop_small_groups": f"{_G}, n as (select g, count(*) as n from g group by 1) select g.id, n.n from g join n on n.g = g.g where n.g not like 'author|%' or n.n >= 2",
    "drop_every_small_group": f"{_G}, n as (select g, count(*) as n from g group by 1) select g.id, n.n from g join n on n.g = g.g where n.n >= 2",
    "stratified_group_split": f"{_STRATA}, o as (select *, row_number() over (partition by stratum order by md5('42:' || g), g) as r, count(*) over (partition by stratum) as n from st) select g.id, o.stratum, {_ROUND} as new_split from g join o on o.g = g.g",
    "multi_seed_split": f"{_STRATA}, o as (select s.seed, st.*, row_number() over (partition by seed, stratum order by md5(s.seed::varchar || ':' || g), g) as r, count(*) over (partition by seed, stratum) as n from st cross join (select unnest(range(5))::int as seed) s) select seed, stratum, {_ROUND} as new_split, count(*) as n, min(g) as first_group from o group by 1, 2, 3".replace("count(*) as n, min(g)", "count(*) as n, min(g)"),
    "group_shuffle_split": f"{_G}, o as (select g, row_number() over (order by md5('7:' || g), g) as r, count(*) over () as n from (select distinct g from g)) select g.id, case when o.r <= ceil(n * 0.10::double) then 'val' else 'train' end as new_split from g join o on o.g = g.g",
    "capped_per_domain": f"{_W}, o as (select k, domain, row_number() over (partition by domain order by md5('cap:' || k), k) as r from corpus where source = 'hc3') select k as id, domain, r from o where r <= 600",
    "text_components": f"""{_G.replace("with corpus", "with recursive corpus", 1)}, t as (select g.g, g.k, md5(c.text) as h from g join corpus c on c.k = g.k), f as (select h, min(g) as u from t where h is not null group by 1),
      e as (select distinct u, g as v from t join f using (h) where u <> g), b as (select u, v from e union select v, u from e), reach as (select distinct u as x, u as y from b union select reach.x, b.v from reach join b on b.u = reach.y),
      comp as (select x as g, min(y) as component from reach group by 1) select component, count(distinct t.g) as n_groups, count(*) as n_records from t join comp on comp.g = t.g group by 1""",
    "leakage_report": f"""{_W}, l as (select split, unnest(['id', 'text', 'author_id', 'prompt', 'source_text_id']) as what, unnest([k, md5(text), author_id, md5(prompt), src]) as value from corpus where split in ('train', 'val', 'test')),
      b as (select what, value, max((split = 'train')::int) as train, max((split = 'val')::int) as val, max((split = 'test')::int) as test from l where value is not null group by 1, 2) select what, {_PAIR('train', 'val')}, {_PAIR('train', 'test')}, {_PAIR('val', 'test')} from b group by 1""",
    "group_size_distribution": f"{_G}, n as (select g, count(*) as size from g group by 1) select size, count(*) as n_groups from n group by 1",
    "class_weights": f"{_W}, n as (select label, count(*) as n from corpus where split = 'train' group by 1) select label, n, round(sum(n) over () / (count(*) over () * greatest(n, 1)), 6) as weight from n",
}
QUERIES = {n: globals()[n] for n in SQL}
