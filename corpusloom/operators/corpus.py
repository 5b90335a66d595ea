"""The corpus of the four text tables and what is asked of its records: normal form, filters, joins, counts, statistics.

A record is the first arrival of its key. Scans read only the columns that a query names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import text as T
from corpusloom.keys import TEXT_TABLES, author, first_arrivals, key, split_name, stripped, text_records
from corpusloom.session import spread, written

_K = "nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"
_S = "nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"
_AU = f"case when {_K.format(c='author_id')} not in ('unknown', 'anonymous', 'n/a') then {_K.format(c='author_id')} end"
_SP = "case {k} when 'training' then 'train' when 'validation' then 'val' when 'dev' then 'val' else {k} end".format(k=_K.format(c="split"))
_ONE = "select '{t}' as tbl, {k} as k, id, text, is_ai, label, {src_} as source, {dom} as domain, {au} as author_id, {mod} as model, prompt, {src} as src, {sp} as split, ingested_at from {t}"
_UNION = " union all ".join(_ONE.format(t=t, k=_K.format(c="id"), src_=_K.format(c="source"), dom=_S.format(c="domain"), au=_AU, mod=_S.format(c="model"), src=_K.format(c="source_text_id"), sp=_SP) for t in TEXT_TABLES)
#: The corpus as a common table expression of DuckDB's SQL.
CORPUS = f"corpus as (select * from (select *, row_number() over (partition by k order by ingested_at) as rn from ({_UNION}) where k is not null) where rn = 1)"
NW = f"len(regexp_extract_all(coalesce(text, ''), '[^{T.SPACE}]+'))"


def nw(c: str) -> str:
    return NW.replace("text", c)


_COLUMNS = {
    "text": lambda: F.col("text"), "is_ai": lambda: F.col("is_ai"), "label": lambda: F.col("label"), "source": lambda: key("source"), "domain": lambda: stripped("domain"), "author_id": lambda: author("author_id"),
    "model": lambda: stripped("model"), "prompt": lambda: F.col("prompt"), "src": lambda: key("source_text_id"), "split": lambda: split_name("split"), "n_words": lambda: T.n_words("text"), "refusal": lambda: T.is_refusal("text"),
    "stripped_hash": lambda: F.md5(T.strip("text")), "text_hash": lambda: F.md5("text"), "prompt_hash": lambda: F.md5("prompt"), "n_chars": lambda: F.length(T.text_of("text")),
}
_COSTLY = {"n_words", "refusal", "stripped_hash"}
_READS = {"src": "source_text_id", "n_words": "text", "refusal": "text", "text_hash": "text", "stripped_hash": "text", "prompt_hash": "prompt", "n_chars": "text"}


def corpus(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """tbl, k, id, at and the columns asked for; derived ones are computed in the scan, so texts aren't shuffled for them."""
    reads = sorted({_READS.get(c, c) for c in columns} | {"id", "ingested_at"})
    rows = text_records(spark, sf_dir, reads)
    if _COSTLY & set(columns):
        rows = spread(rows)
    rows = rows.select("tbl", key("id").alias("k"), F.col("ingested_at").alias("at"), "id", *[_COLUMNS[c]().alias(c) for c in columns])
    return first_arrivals(rows.where("k is not null"), "k", "at", ["at", "tbl", "id", *columns])


def _n(cond) -> F.Column:
    return F.count(F.when(cond, 1))


# ---- projections and filters


def corpus_normalise(spark, d):
    c = corpus(spark, d, ["is_ai", "source", "domain", "author_id", "model", "src", "split", "n_words"])
    return c.select("id", F.when(F.col("is_ai"), "ai").otherwise("human").alias("label"), "source", "domain", "author_id", "model", F.col("src").alias("source_text_id"), "split", "n_words")


def author_key(spark, d):
    c = corpus(spark, d, ["author_id", "model", "source"])
    return c.select("id", F.coalesce("author_id", "model", "k").alias("author_key"), F.coalesce("author_id", "model").isNotNull().alias("has_known_author"), (F.coalesce("source", F.lit("")) == "use_rewrite").alias("is_rewrite"))


def corpus_filter(c: DataFrame, **wanted) -> DataFrame:
    """Conjunction of equalities; None sets no condition."""
    for name, value in wanted.items():
        if value is not None:
            c = c.where(F.col(name) == value)
    return c


def filtered(spark, d):
    c = corpus_filter(corpus(spark, d, ["label", "split", "source", "model"]), label="ai", split="train", source="use_rewrite", model=None)
    return c.select("id", "model")


def length_filter(spark, d, least=100, most=1000):
    c = corpus(spark, d, ["label", "source", "n_words"])
    return c.where(F.col("n_words").between(least, most)).groupBy("label", "source").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"))


def length_drops(spark, d, least=100, most=1000):
    c = corpus(spark, d, ["label", "domain", "source", "n_words"])
    return c.where(~F.col("n_words").between(least, most)).groupBy("label", "domain", "source").agg(F.count("*").alias("dropped"))


def refusal_filter(spark, d):
    c = corpus(spark, d, ["source", "refusal"])
    return c.groupBy("tbl", "source").agg(F.count("*").alias("n"), _n(F.col("refusal")).alias("refused"))


def acceptance_gate(spark, d, least=30):
    """Rewrites with enough words that don't repeat their prompt, and those that fail, by model."""
    c = corpus(spark, d, ["model", "n_words", "text_hash", "prompt_hash"]).where("tbl = 'rewritten_texts'")
    ok = (F.col("n_words") >= least) & ~F.col("text_hash").eqNullSafe(F.col("prompt_hash"))
    return c.groupBy("model").agg(_n(ok).alias("accepted"), _n(~ok).alias("rejected"))


def with_global_rank(df: DataFrame, order: str, name: str, buckets_by: F.Column | None = None, part: list[str] | None = None) -> DataFrame:
    """The 1-based rank of a string column over all rows (or within `part`), without one task that holds them all.

    Rows are cut into buckets by the first characters of the column (of an md5 they are even), the few bucket counts are
    added up in order, and rows are numbered within their bucket.
    """
    part = part or []
    rows = df.withColumn("_b", buckets_by if buckets_by is not None else F.substring(order, 1, 3))
    counts = rows.groupBy(*part, "_b").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(W.partitionBy(*part).orderBy("_b")) - F.col("_c")).drop("_c")
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*part, "_b").orderBy(order)))
    on = [ranked[c].eqNullSafe(before[c]) for c in [*part, "_b"]]
    return ranked.join(before, on).select(*[ranked[c] for c in df.columns], (F.col("_before") + F.col("_r")).cast("bigint").alias(name))


def ranged_rank(df: DataFrame, order: list[str], name: str, part: list[str] | None = None) -> DataFrame:
    """The 1-based rank in the order of some columns (within `part`), whatever values they have.

    Rows are cut into ranges of about one size and written; the ranges' counts are added up in order, and rows are
    numbered within their range. No task holds a large part; rows that agree in all columns are told apart at will.
    """
    part = part or []
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(tasks, *part, *order).withColumn("_b", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(*part, "_b").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(W.partitionBy(*part).orderBy("_b")) - F.col("_c")).drop("_c")
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*part, "_b").orderBy(*order)))
    on = [ranked[c].eqNullSafe(before[c]) for c in [*part, "_b"]]
    return ranked.join(before, on).select(*[ranked[c] for c in df.columns], (F.col("_before") + F.col("_r")).cast("bigint").alias(name))


def id_synthesis(spark, d):
    c = corpus(spark, d, [])
    p = F.when(F.col("tbl") == "human_texts", "h").when(F.col("tbl") == "ai_texts", "a").otherwise("r")
    c = c.select(p.alias("p"), F.concat(F.md5("k"), F.col("k")).alias("h"), "k")
    return with_global_rank(c, "h", "n", part=["p"]).select(F.col("k").alias("id"), F.format_string("%s_%04d", "p", "n").alias("new_id"))


def first_seen_author_id(spark, d):
    """Dense running numbers of authors in the order of their first record (ties by name)."""
    a = corpus(spark, d, ["author_id"]).where("author_id is not null").groupBy("author_id").agg(F.min("at").alias("first"))
    return ranged_rank(a, ["first", "author_id"], "n").select("author_id", F.format_string("ax_%03d", "n").alias("new_author_id"))


def stride_sample(spark, d, limit=100):
    """Every (n div limit)-th record of human_texts in the order of md5(id), at most `limit`: a sampling operator."""
    c = corpus(spark, d, []).where("tbl = 'human_texts'").select("k", F.concat(F.md5("k"), F.col("k")).alias("h"))
    n = c.count()
    r = with_global_rank(c, "h", "r")
    return r.where(((F.col("r") - 1) % max(1, n // limit) == 0) & (F.col("r") <= limit * max(1, n // limit))).select(F.col("k").alias("id"))


def placeholder_rewrite(spark, d):
    """Texts with ' is ' as ' was ' and ' the ' as ' a ', by hash."""
    c = text_records(spark, d, ["id", "text"]).where("tbl = 'human_texts'").select(key("id").alias("id"), F.md5(F.replace(F.replace("text", F.lit(" is "), F.lit(" was ")), F.lit(" the "), F.lit(" a "))).alias("text_hash"))
    return c.distinct()


# ---- joins


def rewrites_with_source(spark, d):
    """Rewrites with what they take over from their source record; unmatched ones are dropped."""
    c = corpus(spark, d, ["domain", "author_id", "split", "model", "src"])
    r = c.where("tbl = 'rewritten_texts' and src is not null").select("id", "model", "src")
    h = c.where("tbl = 'human_texts'").select(F.col("k").alias("src"), "domain", "author_id", "split")
    return r.join(h, "src").select("id", "model", F.col("src").alias("source_text_id"), "domain", "author_id", "split")


def rewrite_missing_source(spark, d):
    c = corpus(spark, d, ["model", "src"])
    r, h = c.where("tbl = 'rewritten_texts'"), c.where("tbl = 'human_texts'").select(F.col("k").alias("src"), F.lit(True).alias("there"))
    return r.join(h, "src", "left").groupBy("model").agg(F.count("*").alias("n"), _n(F.col("there").isNull()).alias("missing_source"))


def orphan_rewrites(spark, d):
    c = corpus(spark, d, ["src"])
    h = c.where("tbl = 'human_texts'").select(F.col("k").alias("src"))
    return c.where("tbl = 'rewritten_texts' and src is not null").join(h, "src", "left_anti").select("id")


def content_backlink(spark, d):
    """Rewrites whose text is that of a human record of the same author, with the first such record."""
    c = corpus(spark, d, ["author_id", "text_hash"])
    h = c.where("tbl = 'human_texts' and author_id is not null").groupBy("author_id", "text_hash").agg(F.min("k").alias("found"))
    r = c.where("tbl in ('rewritten_texts', 'humanized_texts')")
    return r.join(h, ["author_id", "text_hash"]).select("id", F.col("found").alias("source_id"))


def author_siblings(spark, d):
    """Other records of the same author: counted by author, not by pairs, so a large author costs one row."""
    c = corpus(spark, d, ["author_id", "label"]).where("author_id is not null")
    n = c.groupBy("author_id").agg(F.count("*").alias("n"), _n(F.col("label") == "human").alias("h"))
    same = F.when(F.col("label") == "human", F.col("h")).otherwise(F.col("n") - F.col("h"))
    return c.join(n, "author_id").select("id", (F.col("n") - 1).alias("siblings"), (same - 1).alias("same_label"))


def human_siblings(spark, d):
    """Human records of the same author, without the record itself and, of a rewrite, without its own source."""
    c = corpus(spark, d, ["author_id", "label", "source", "src"])
    n = c.where("author_id is not null and label = 'human'").groupBy("author_id").agg(F.count("*").alias("h"))
    own = c.where("label = 'human' and author_id is not null").select(F.col("k").alias("src"), F.col("author_id").alias("src_author"))
    rows = c.where("author_id is not null").join(n, "author_id", "left").join(own, "src", "left")
    less = (F.col("label") == "human").cast("int") + ((F.col("source") == "use_rewrite") & F.col("src_author").eqNullSafe(F.col("author_id")) & (F.col("src") != F.col("k"))).cast("int")
    return rows.select("id", (F.coalesce("h", F.lit(0)) - F.coalesce(less, F.lit(0))).alias("human_siblings"))


def min_sibling_filter(spark, d, least=3):
    return human_siblings(spark, d).where(F.col("human_siblings") >= least).select("id")


def cluster_members(spark, d):
    """Rewrite clusters: the rewrites of a source and, if it has any, the source itself; members besides each record."""
    c = corpus(spark, d, ["src"])
    r = c.where("tbl = 'rewritten_texts'").select("id", F.coalesce("src", "k").alias("cluster"))
    h = c.where("tbl = 'human_texts'").select("id", F.col("k").alias("cluster")).join(r.select("cluster").distinct(), "cluster", "left_semi").select("id", "cluster")
    every = r.unionByName(h)
    n = every.groupBy("cluster").agg((F.count("*") - 1).alias("others"))
    return every.join(n, "cluster").select("id", F.col("cluster").alias("cluster_id"), "others")


def pending_by_model(spark, d):
    """Human records that a rewriter has not done: all less the distinct sources it has."""
    c = corpus(spark, d, ["model", "src", "source"])
    h = c.where("tbl = 'human_texts' and source in ('use', 'arxiv')").select(F.col("k").alias("src"))
    done = c.where("tbl = 'rewritten_texts' and model is not null").join(h, "src", "left_semi").select("model", "src").distinct().groupBy("model").agg(F.count("*").alias("done"))
    return done.select("model", "done", (F.lit(h.count()) - F.col("done")).alias("pending"))


def pending_anti(spark, d):
    c = corpus(spark, d, ["src", "source"])
    h = c.where("tbl = 'human_texts' and source in ('use', 'arxiv')")
    return h.join(c.where("tbl = 'rewritten_texts'").select(F.col("src").alias("k")), "k", "left_anti").select("id")


def scored_semi(spark, d):
    """Records that some detector scored."""
    from corpusloom.session import table

    s = table(spark, d, "detector_scores").select(key("id").alias("k"))
    return corpus(spark, d, []).join(s, "k", "left_semi").select("id", "tbl")


# ---- counts and statistics


def union_all_pools(spark, d):
    c = corpus(spark, d, ["source", "label", "domain"])
    return c.groupBy("tbl", "source", "label").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("n_domains"))


def summary_by_split(spark, d):
    """Counts by split and label, domain or source, and all of them, in one pass by grouping sets."""
    c = corpus(spark, d, ["split", "label", "domain", "source"])
    g = c.groupingSets([["split"], ["split", "label"], ["split", "domain"], ["split", "source"]], "split", "label", "domain", "source")
    out = g.agg(F.count("*").alias("n"), F.grouping("label").alias("gl"), F.grouping("domain").alias("gd"), F.grouping("source").alias("gs"))
    what = F.when(F.col("gl") == 0, "label").when(F.col("gd") == 0, "domain").when(F.col("gs") == 0, "source").otherwise("all")
    return out.select("split", what.alias("what"), F.coalesce("label", "domain", "source").alias("value"), "n")


def length_stats(spark, d):
    """n, least, upper median (sorted[n // 2]), mean to one place and most words by split and label.

    Exact from counts by length: the window runs over the distinct lengths of a group, not over its records.
    """
    c = corpus(spark, d, ["split", "label", "n_words"]).groupBy("split", "label", "n_words").agg(F.count("*").alias("c"))
    w = W.partitionBy("split", "label")
    c = c.withColumns({"upto": F.sum("c").over(w.orderBy("n_words")), "n": F.sum("c").over(w)})
    return c.groupBy("split", "label").agg(F.max("n").alias("n"), F.min("n_words").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("n_words"))).alias("median"), F.round(F.sum(F.col("n_words") * F.col("c")) / F.max("n"), 1).alias("mean"), F.max("n_words").alias("most"))


def authors_summary(spark, d):
    a = corpus(spark, d, ["author_id"]).where("author_id is not null").groupBy("author_id").agg(F.count("*").alias("n"))
    return a.agg(F.sum("n").alias("records"), F.count("*").alias("authors"), _n(F.col("n") > 1).alias("with_more"), F.max("n").alias("most"))


def author_groups_having(spark, d, least=5):
    a = corpus(spark, d, ["author_id", "label"]).where("author_id is not null").groupBy("author_id").agg(F.count("*").alias("n"), _n(F.col("label") == "human").alias("n_human"))
    return a.where(F.col("n") >= least)


def duplicate_texts(spark, d):
    c = corpus(spark, d, ["text_hash", "split"]).where("text_hash is not null").groupBy("text_hash").agg(F.count("*").alias("n"), F.countDistinct("split").alias("n_splits"), F.min("k").alias("first_id"))
    return c.where("n > 1")


def texts_per_author(spark, d):
    a = corpus(spark, d, ["author_id"]).where("author_id is not null").groupBy("tbl", "author_id").agg(F.count("*").alias("n"))
    return a.groupBy("tbl").agg(F.count("*").alias("authors"), F.min("n").alias("least"), F.round(F.avg("n"), 2).alias("mean"), F.max("n").alias("most"), F.bool_and(F.col("n") >= 2).alias("all_two"))


def top_author_share(spark, d, k=10):
    a = corpus(spark, d, ["author_id"]).where("author_id is not null").groupBy("author_id").agg(F.count("*").alias("n"))
    n = a.agg(F.sum("n")).first()[0]
    top = a.orderBy(F.desc("n"), "author_id").limit(k).agg(F.sum("n").alias("top"))
    return top.select("top", F.lit(n).alias("n"), F.round(F.col("top") / F.lit(n), 6).alias("share"))


def describe_percentiles(spark, d):
    """Percentiles (linear) of words by table, exact from counts by length."""
    c = corpus(spark, d, ["n_words"]).groupBy("tbl", "n_words").agg(F.count("*").alias("c"))
    ps = [0.1, 0.25, 0.5, 0.75, 0.9]
    q = F.percentile("n_words", F.array(*[F.lit(p) for p in ps]), F.col("c"))
    return c.groupBy("tbl").agg(F.sum("c").alias("n"), q.alias("q")).select("tbl", "n", *[F.round(F.col("q")[i], 6).alias(f"p{int(p * 100)}") for i, p in enumerate(ps)])


def rewrites_per_source(spark, d):
    c = corpus(spark, d, ["src", "author_id"]).where("tbl = 'rewritten_texts'")
    one = lambda col: c.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).agg(F.lit(col).alias("per"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 2).alias("mean"))
    return one("src").unionByName(one("author_id"))


def length_ratio(spark, d):
    """Words of rewrites against their originals, by model: mean ratio, median and share of changes beyond 30 per cent."""
    c = corpus(spark, d, ["model", "src", "n_words"])
    h = c.where("tbl = 'human_texts' and n_words > 0").select(F.col("k").alias("src"), F.col("n_words").alias("of"))
    j = c.where("tbl = 'rewritten_texts'").join(h, "src").withColumn("delta", (F.col("n_words") - F.col("of")) / F.col("of"))
    return j.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.col("n_words") / F.col("of")), 6).alias("ratio"), F.round(F.percentile("delta", F.lit(0.5)), 6).alias("median_delta"), F.round(F.avg((F.abs("delta") > 0.3).cast("int")), 6).alias("beyond"))


def paired_quality(spark, d, near=0.95):
    """Rewrites by model and the first quality rule that holds: refusal, missing_source, echo, too_short, too_long, near_duplicate, clean.

    A near duplicate differs in less than 1 - near of the longer text's characters, over the whole texts.
    """
    rec = corpus(spark, d, ["model", "src", "n_words", "refusal", "stripped_hash", "text"])
    r = rec.where("tbl = 'rewritten_texts'").select("k", "model", "src", "refusal", F.col("n_words").alias("n"), F.col("stripped_hash").alias("s"), T.text_of("text").alias("a"))
    h = rec.where("tbl = 'human_texts'").select(F.col("k").alias("src"), F.lit(True).alias("there"), F.col("n_words").alias("of"), F.col("stripped_hash").alias("os"), T.text_of("text").alias("b"))
    n, of = F.col("n"), F.col("of")
    rule = F.when(F.col("refusal"), "refusal").when(F.col("there").isNull(), "missing_source").when(F.col("s") == F.col("os"), "echo")
    rule = rule.when((n < 30) | (n < 0.30 * of), "too_short").when(n > 2.0 * of, "too_long")
    j = r.join(h, "src", "left").withColumn("rule", rule).withColumn("most", (1 - near) * F.greatest(F.length("a"), F.length("b")))
    # the distance is at least the difference in length: only pairs still open and nearly as long are compared
    asked = F.col("rule").isNull() & (F.abs(F.length("a") - F.length("b")) < F.col("most"))
    dist = T.edit_distance(F.when(asked, F.col("a")), F.when(asked, F.col("b")))
    return j.select("k", "model", F.coalesce("rule", F.when(dist < F.col("most"), "near_duplicate"), F.lit("clean")).alias("rule"))


def quality_rules(spark, d):
    return paired_quality(spark, d).groupBy("model", "rule").agg(F.count("*").alias("n"))


def provider_issue_pivot(spark, d):
    kinds = ["refusal", "missing_source", "echo", "too_short", "too_long", "near_duplicate", "clean"]
    q = paired_quality(spark, d)
    return q.groupBy("model").agg(F.count("*").alias("n"), *[_n(F.col("rule") == x).alias(x) for x in kinds], F.round(100.0 * _n(F.col("rule") != "clean") / F.count("*"), 2).alias("issue_percent"))


def split_ratio(spark, d):
    """Records, human and AI, and their ratio by split."""
    c = corpus(spark, d, ["split", "label"]).groupBy("split").agg(F.count("*").alias("n"), _n(F.col("label") == "human").alias("human"), _n(F.col("label") == "ai").alias("ai"))
    return c.withColumn("ai_per_human", F.when(F.col("human") > 0, F.round(F.col("ai") / F.col("human") + T.NUDGE, 6)))


def group_summary(spark, d):
    """Mean words by source for both labels side by side, and their difference."""
    c = corpus(spark, d, ["domain", "label", "n_words"])
    p = c.groupBy("domain").pivot("label", ["human", "ai"]).agg(F.avg("n_words"))
    return p.select("domain", *[F.round(F.col(x) + T.NUDGE, 5).alias(x) for x in ("human", "ai")], F.round(F.col("ai") - F.col("human") + T.NUDGE, 5).alias("delta"))


def sentence_refs(spark, d, least=6, first=50):
    """The first sentences of each label (in the order of md5 of the record) with more than five words: a sampling operator."""
    rows = text_records(spark, d, ["id", "label", "text", "ingested_at"]).select("tbl", key("id").alias("k"), F.col("ingested_at").alias("at"), "label", F.filter(F.split(T.text_of("text"), r"\."), lambda s: F.regexp_count(s, F.lit(r"[^\s]+")) >= least).alias("l")).where("k is not null")
    s = rows.select("k", "label", F.posexplode("l").alias("pos", "sentence")).select("label", F.concat(F.md5("k"), F.lit("|"), F.col("k"), F.lit("|"), F.lpad(F.col("pos").cast("string"), 9, "0")).alias("h"), "k", "pos").distinct()
    return with_global_rank(s, "h", "r", part=["label"]).where(F.col("r") <= first).select("label", F.col("k").alias("id"), "pos", "r")


def edit_sql(a: str, b: str) -> str:
    """Edits between two texts and the longer length, as a struct. DuckDB counts bytes: a pair's other characters (at most 17) stand as control characters that texts don't hold."""
    others = f"list_distinct(regexp_extract_all(coalesce({a}, '') || coalesce({b}, ''), '[^\\x00-\\x7f]'))"
    one = lambda c: f"list_reduce(list_concat([coalesce({c}, '')], {others}), lambda acc, c, i: replace(acc, c, chr(14 + i::int)))"
    return f"{{'edits': levenshtein({one(a)}, {one(b)}), 'longer': greatest(length(coalesce({a}, '')), length(coalesce({b}, '')))}}"


_Q = f"""r as (select k, model, src, text from corpus where tbl = 'rewritten_texts'), h as (select k as src, text as orig, true as there from corpus where tbl = 'human_texts'),
  p as (select r.k, r.model, r.text, h.orig, h.there, {nw('r.text')} as n, {nw('h.orig')} as ow,
    {edit_sql('r.text', 'h.orig')} as e from r left join h on r.src = h.src),
  q as (select k, model, case when regexp_matches(substr(coalesce(text, ''), 1, 200), '{T.REFUSAL.replace("'", "''")}') then 'refusal' when there is null then 'missing_source'
    when regexp_replace(coalesce(text, ''), '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g') = regexp_replace(coalesce(orig, ''), '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g') then 'echo'
    when n < 30 or n < 0.30::double * ow then 'too_short' when n > 2.0::double * ow then 'too_long'
    when e.edits < (1 - 0.95::double) * e.longer then 'near_duplicate' else 'clean' end as rule from p)"""

_W = f"with {CORPUS}"
_REF = T.REFUSAL.replace("'", "''")
SQL = {
    "corpus_normalise": f"{_W} select id, case when is_ai then 'ai' else 'human' end as label, source, domain, author_id, model, src as source_text_id, split, {NW} as n_words from corpus",
    "author_key": f"{_W} select id, coalesce(author_id, model, k) as author_key, coalesce(author_id, model) is not null as has_known_author, coalesce(source, '') = 'use_rewrite' as is_rewrite from corpus",
    "corpus_filter": f"{_W} select id, model from corpus where label = 'ai' and split = 'train' and source = 'use_rewrite'",
    "length_filter": f"{_W}, n as (select *, {NW} as n_words from corpus) select label, source, count(*) as n, sum(n_words) as n_words from n where n_words between 100 and 1000 group by 1, 2",
    "length_drops": f"{_W} select label, domain, source, count(*) as dropped from corpus where {NW} not between 100 and 1000 group by 1, 2, 3",
    "refusal_filter": f"{_W} select tbl, source, count(*) as n, count(*) filter (regexp_matches(substr(coalesce(text, ''), 1, 200), '{_REF}')) as refused from corpus group by 1, 2",
    "acceptance_gate": f"{_W}, g as (select model, {NW} >= 30 and text is distinct from prompt as ok from corpus where tbl = 'rewritten_texts') select model, count(*) filter (ok) as accepted, count(*) filter (not ok) as rejected from g group by 1",
    "id_synthesis": f"{_W}, p as (select k, case tbl when 'human_texts' then 'h' when 'ai_texts' then 'a' else 'r' end as p from corpus) select k as id, printf('%s_%04d', p, row_number() over (partition by p order by md5(k), k)) as new_id from p",
    "first_seen_author_id": f"{_W}, a as (select author_id, min(ingested_at) as f from corpus where author_id is not null group by 1) select author_id, printf('ax_%03d', row_number() over (order by f, author_id)) as new_author_id from a",
    "stride_sample": f"{_W}, h as (select k, row_number() over (order by md5(k), k) as r, count(*) over () as n from corpus where tbl = 'human_texts') select k as id from h where (r - 1) % greatest(1, n // 100) = 0 and r <= 100 * greatest(1, n // 100)",
    "placeholder_rewrite": f"select distinct {_K.format(c='id')} as id, md5(replace(replace(text, ' is ', ' was '), ' the ', ' a ')) as text_hash from human_texts",
    "rewrites_with_source": f"{_W} select r.id, r.model, r.src as source_text_id, h.domain, h.author_id, h.split from corpus r join corpus h on h.k = r.src and h.tbl = 'human_texts' where r.tbl = 'rewritten_texts'",
    "rewrite_missing_source": f"{_W} select r.model, count(*) as n, count(*) filter (h.k is null) as missing_source from corpus r left join corpus h on h.k = r.src and h.tbl = 'human_texts' where r.tbl = 'rewritten_texts' group by 1",
    "orphan_rewrites": f"{_W} select id from corpus where tbl = 'rewritten_texts' and src is not null and src not in (select k from corpus where tbl = 'human_texts')",
    "content_backlink": f"{_W} select r.id, min(h.k) as source_id from corpus r join corpus h on h.tbl = 'human_texts' and h.author_id = r.author_id and h.text = r.text where r.tbl in ('rewritten_texts', 'humanized_texts') group by r.id",
    "author_siblings": f"{_W} select id, count(*) over (partition by author_id) - 1 as siblings, count(*) over (partition by author_id, label) - 1 as same_label from corpus where author_id is not null",
    "human_siblings": f"{_W} select a.id, count(b.k) as human_siblings from corpus a left join corpus b on b.author_id = a.author_id and b.label = 'human' and b.k <> a.k and not (coalesce(a.source, '') = 'use_rewrite' and b.k is not distinct from a.src) where a.author_id is not null group by a.id",
    "min_sibling_filter": f"{_W} select a.id from corpus a join corpus b on b.author_id = a.author_id and b.label = 'human' and b.k <> a.k and not (coalesce(a.source, '') = 'use_rewrite' and b.k is not distinct from a.src) group by a.id having count(*) >= 3",
    "cluster_members": f"{_W}, r as (select id, coalesce(src, k) as c from corpus where tbl = 'rewritten_texts'), e as (select * from r union all select id, k from corpus where tbl = 'human_texts' and k in (select c from r)) select id, c as cluster_id, count(*) over (partition by c) - 1 as others from e",
    "pending_by_model": f"{_W}, h as (select k from corpus where tbl = 'human_texts' and source in ('use', 'arxiv')) select model, count(distinct src) as done, (select count(*) from h) - count(distinct src) as pending from corpus where tbl = 'rewritten_texts' and model is not null and src in (select k from h) group by 1",
    "pending_anti": f"{_W} select id from corpus where tbl = 'human_texts' and source in ('use', 'arxiv') and k not in (select src from corpus where tbl = 'rewritten_texts' and src is not null)",
    "scored_semi": f"{_W} select id, tbl from corpus where k in (select {_K.format(c='id')} from detector_scores where {_K.format(c='id')} is not null)",
    "union_all_pools": f"{_W} select tbl, source, label, count(*) as n, count(distinct domain) as n_domains from corpus group by 1, 2, 3",
    "summary_by_split": f"{_W} select split, case when grouping(label) = 0 then 'label' when grouping(domain) = 0 then 'domain' when grouping(source) = 0 then 'source' else 'all' end as what, coalesce(label, domain, source) as value, count(*) as n from corpus group by grouping sets ((split), (split, label), (split, domain), (split, source))",
    "length_stats": f"{_W}, n as (select split, label, {NW} as w from corpus) select split, label, count(*) as n, min(w) as least, list_sort(list(w))[count(*) // 2 + 1] as median, round(avg(w), 1) as mean, max(w) as most from n group by 1, 2",
    "authors_summary": f"{_W}, a as (select author_id, count(*) as n from corpus where author_id is not null group by 1) select sum(n) as records, count(*) as authors, count(*) filter (n > 1) as with_more, max(n) as most from a",
    "author_groups_having": f"{_W} select author_id, count(*) as n, count(*) filter (label = 'human') as n_human from corpus where author_id is not null group by 1 having count(*) >= 5",
    "duplicate_texts": f"{_W} select md5(text) as text_hash, count(*) as n, count(distinct split) as n_splits, min(k) as first_id from corpus where text is not null group by 1 having count(*) > 1",
    "texts_per_author": f"{_W}, a as (select tbl, author_id, count(*) as n from corpus where author_id is not null group by 1, 2) select tbl, count(*) as authors, min(n) as least, round(avg(n), 2) as mean, max(n) as most, bool_and(n >= 2) as all_two from a group by 1",
    "top_author_share": f"{_W}, a as (select author_id, count(*) as n from corpus where author_id is not null group by 1), t as (select n from a order by n desc, author_id limit 10) select (select sum(n) from t) as top, sum(n) as n, round((select sum(n) from t) / sum(n), 6) as share from a",
    "describe_percentiles": f"{_W}, n as (select tbl, {NW} as w from corpus) select tbl, count(*) as n, round(quantile_cont(w, 0.1), 6) as p10, round(quantile_cont(w, 0.25), 6) as p25, round(quantile_cont(w, 0.5), 6) as p50, round(quantile_cont(w, 0.75), 6) as p75, round(quantile_cont(w, 0.9), 6) as p90 from n group by 1",
    "rewrites_per_source": f"{_W}, s as (select src, count(*) as n from corpus where tbl = 'rewritten_texts' and src is not null group by 1), a as (select author_id, count(*) as n from corpus where tbl = 'rewritten_texts' and author_id is not null group by 1) select 'src' as per, min(n) as least, max(n) as most, round(avg(n), 2) as mean from s union all select 'author_id', min(n), max(n), round(avg(n), 2) from a",
    "length_ratio": f"{_W}, n as (select *, {NW} as w from corpus), j as (select r.model, r.w, h.w as o, (r.w - h.w) / h.w as delta from n r join n h on h.k = r.src and h.tbl = 'human_texts' and h.w > 0 where r.tbl = 'rewritten_texts') select model, count(*) as n, round(avg(w / o), 6) as ratio, round(quantile_cont(delta, 0.5), 6) as median_delta, round(avg((abs(delta) > 0.3)::int), 6) as beyond from j group by 1",
    "split_ratio": f"{_W}, c as (select split, count(*) as n, count(*) filter (label = 'human') as human, count(*) filter (label = 'ai') as ai from corpus group by 1) select *, case when human > 0 then round(ai / human + 1e-9, 6) end as ai_per_human from c",
    "group_summary": f"{_W}, m as (select domain, avg({NW}) filter (label = 'human') as h, avg({NW}) filter (label = 'ai') as a from corpus group by 1) select domain, round(h + 1e-9, 5) as human, round(a + 1e-9, 5) as ai, round(a - h + 1e-9, 5) as delta from m",
    "sentence_refs": f"{_W}, l as (select k, label, list_filter(string_split(coalesce(text, ''), '.'), lambda s: len(regexp_extract_all(s, '[^\\s]+')) >= 6) as l from corpus), s as (select k, label, unnest(range(len(l)))::int as pos from l), r as (select *, row_number() over (partition by label order by md5(k), k, pos) as r from s) select label, k as id, pos, r from r where r <= 50",
    "quality_rules": f"{_W}, {_Q} select model, rule, count(*) as n from q group by 1, 2",
    "provider_issue_pivot": f"{_W}, {_Q} select model, count(*) as n, " + ", ".join(f"count(*) filter (rule = '{x}') as {x}" for x in ["refusal", "missing_source", "echo", "too_short", "too_long", "near_duplicate", "clean"]) + ", round(100.0::double * count(*) filter (rule <> 'clean') / count(*), 2) as issue_percent from q group by 1",
}
QUERIES = {n: globals()[{"corpus_filter": "filtered"}.get(n, n)] for n in SQL}
