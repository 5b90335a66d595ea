"""Look-up joins with defaults, memberships, coverage, ordered reports and text rules of the corpus and its evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import text as T
from corpusloom.keys import author, key
from corpusloom.operators import metrics
from corpusloom.operators.corpus import _K, CORPUS, _n, corpus, edit_sql, ranged_rank
from corpusloom.operators.features import _pairs
from corpusloom.operators.metrics import _SCORES, clean_vs_humanized, per_source_accuracy, roc_auc, scores, strict_fpr_roc
from corpusloom.session import table

_W = f"with {CORPUS}"
#: Sources by the pool they are taken into; other sources are in none.
BUCKETS = {"human": ("use", "arxiv"), "rewrite": ("use_rewrite", "arxiv_rewrite"), "generated": ("argugpt", "raid")}
#: detectors' thresholds and which side of it is AI; of others a half, from which on it is AI.
THRESHOLDS = {"twinlens": (0.901, "below"), "rewritegap": (0.65, "from"), "curvature": (0.5, "from")}


# ---- look-ups


def with_metadata(features: DataFrame, meta: DataFrame, on: str) -> DataFrame:
    """features with author_id and source of meta: missing_<id> where there is no such record, singleton_<id> for one without author, source '?' by default."""
    m = meta.select(F.col(on).alias("_k"), F.lit(True).alias("_there"), F.col("author_id").alias("_author"), F.col("source").alias("_source"))
    j = features.join(m, features[on] == m["_k"], "left")
    who = F.when(F.col("_there").isNull(), F.concat(F.lit("missing_"), F.col(on).cast("string"))).otherwise(F.coalesce("_author", F.concat(F.lit("singleton_"), F.col(on).cast("string"))))
    return j.select(*features.columns, who.alias("author_id"), F.coalesce("_source", F.lit("?")).alias("source"))


def feature_metadata(spark, d):
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), author("author_id").alias("author_id"), key("source").alias("source")).where("vec_id is not null")
    return with_metadata(table(spark, d, "embeddings").select("vec_id", "label"), meta, "vec_id")


def cache_join(spark, d):
    """Records by split, and how many of them a cache (here: texts with a score) lacks."""
    c = corpus(spark, d, ["split"]).select("k", "split")
    cache = scores(spark, d).select("k", F.lit(True).alias("cached")).where("k is not null").distinct()
    return c.join(cache, "k", "left").groupBy("split").agg(F.count("*").alias("n"), F.count("cached").alias("cached"), _n(F.col("cached").isNull()).alias("missing"))


def merged_lines(human: DataFrame, ai: DataFrame, canonical: DataFrame, *, strict: bool = False) -> DataFrame:
    """detector, pos, k, y_true, y_score: human and AI lines together in the canonical order (k, pos); lines of other ids are left out.

    strict: a detector that lacks a canonical id raises before anything is used. Of an id with several lines the least counts.
    """
    lines = human.unionByName(ai).join(canonical, "k").groupBy("detector", "pos", "k").agg(F.min(F.struct("y_true", "y_score")).alias("l")).select("detector", "pos", "k", "l.y_true", "l.y_score")
    if strict:
        n = canonical.count()
        short = lines.groupBy("detector").agg(F.count("*").alias("n")).where(F.col("n") != n).limit(5).collect()
        if short:
            raise ValueError(f"of {n} canonical ids " + ", ".join(f"{r['detector']} has {r['n']}" for r in short))
    return lines


def merged_evaluation(spark, d):
    """Each detector's lines on human and on humanized texts, in the order of the texts' ids."""
    c = corpus(spark, d, []).where("tbl in ('human_texts', 'humanized_texts')").select("k", "tbl")
    s = scores(spark, d).select("detector", "k", "y_true", "y_score").join(c, "k")
    canonical = ranged_rank(s.select("k").distinct(), ["k"], "pos")
    pick = lambda t, y: s.where((F.col("tbl") == t) & (F.col("y_true") == y)).drop("tbl")
    return merged_lines(pick("human_texts", 0), pick("humanized_texts", 1), canonical)


def quadruples(spark, d):
    """Human abstracts with their rewrites and humanized rewrites: how many, and whether a text of each kind is there."""
    c = corpus(spark, d, ["source", "src"])
    h = c.where("tbl = 'human_texts' and source = 'arxiv'").select("id", "k")
    r = c.where("tbl = 'rewritten_texts' and src is not null").select(F.col("k").alias("r"), F.col("src").alias("k"))
    z = c.where("tbl = 'humanized_texts' and src is not null").groupBy(F.col("src").alias("r")).agg(F.count("*").alias("z"))
    got = r.join(z, "r", "left").groupBy("k").agg(F.count("*").alias("n_rewrites"), F.coalesce(F.sum("z"), F.lit(0)).alias("n_humanized"))
    n = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return h.join(got, "k", "left").select("id", n("n_rewrites"), n("n_humanized"), (F.coalesce("n_humanized", F.lit(0)) > 0).alias("complete"))


def author_members(spark, d):
    """Membership of each record with an author in its group by author and label."""
    return corpus(spark, d, ["author_id", "label"]).where("author_id is not null").select("author_id", "label", "id")


def cluster_rows(spark, d):
    """Rewrite clusters as rows: the rewrites of a source and, if there are any, the source itself."""
    c = corpus(spark, d, ["src"])
    r = c.where("tbl = 'rewritten_texts'").select(F.coalesce("src", "k").alias("cluster_id"), "id", F.lit("rewrite").alias("role"))
    h = c.where("tbl = 'human_texts'").select(F.col("k").alias("cluster_id"), "id", F.lit("source").alias("role"))
    return r.unionByName(h.join(r.select("cluster_id").distinct(), "cluster_id", "left_semi"))


# ---- coverage and ordered reports


def style_coverage(spark, d):
    """Share of human records with at least one rewrite, by source and over all (source null, what 'all'), in one pass."""
    c = corpus(spark, d, ["source", "src"])
    done = c.where("tbl = 'rewritten_texts' and src is not null").select(F.col("src").alias("k"), F.lit(1).alias("ok")).distinct()
    h = c.where("tbl = 'human_texts'").join(done, "k", "left").groupingSets([["source"], []], "source")
    out = h.agg(F.count("*").alias("n"), F.count("ok").alias("n_ok"), F.grouping("source").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise("source").alias("what"), "source", "n", F.round(F.col("n_ok") / F.col("n") + T.NUDGE, 6).alias("coverage"))


def positive_drop_share(spark, d):
    """Each detector's share of all losses of macro-F1 by humanizing; gains count as 0."""
    m = clean_vs_humanized(spark, d).select("detector", F.greatest(-F.coalesce("delta_f1", F.lit(0.0)), F.lit(0.0)).alias("drop"))
    total = F.sum("drop").over(W.partitionBy())  # one row a detector
    return m.select("detector", F.round(F.when(total > 0, F.col("drop") / total).otherwise(0.0) + T.NUDGE, 5).alias("share"))


def _placed(df: DataFrame, *order: Column) -> DataFrame:
    """df with place, its rows' order; for reports of one row a detector, model or source."""
    return df.withColumn("place", F.row_number().over(W.orderBy(*order)))


def roc_legend(spark, d):
    return _placed(roc_auc(spark, d).select("detector", "auc"), F.desc_nulls_last("auc"), F.col("detector"))


def counts_falling(spark, d):
    c = corpus(spark, d, ["model"]).where("model is not null").groupBy("model").agg(F.count("*").alias("n"))
    return _placed(c, F.desc("n"), F.col("model"))


def sources_rising(spark, d):
    return per_source_accuracy(spark, d).withColumn("place", F.row_number().over(W.partitionBy("detector").orderBy(F.asc_nulls_first("source"))))


def strict_rate_order(spark, d):
    """Detectors by their rate at the strict threshold, falling; nulls last."""
    return _placed(strict_fpr_roc(spark, d).select("detector", "tpr"), F.desc_nulls_last("tpr"), F.col("detector"))


def author_bands(spark, d, few=5, many=20):
    a = corpus(spark, d, ["author_id"]).where("author_id is not null").groupBy("author_id").agg(F.count("*").alias("n"))
    return a.agg(F.count("*").alias("authors"), _n(F.col("n") <= few).alias("few"), _n(F.col("n") >= many).alias("many"), F.coalesce(F.sum(F.when(F.col("n") >= many, F.col("n"))), F.lit(0)).alias("records_of_many"))


def author_head_tail(spark, d, k=20):
    """The k authors with most and the k with fewest records, ties by name: a top-k report."""
    a = corpus(spark, d, ["author_id"]).where("author_id is not null").groupBy("author_id").agg(F.count("*").alias("n"))
    head = a.orderBy(F.desc("n"), "author_id").limit(k).withColumn("at", F.lit("head"))
    return head.unionByName(a.orderBy("n", F.desc("author_id")).limit(k).withColumn("at", F.lit("tail"))).select("at", "author_id", "n")


def author_medians(spark, d):
    """Texts per author by table: the upper median too, from counts of counts."""
    a = corpus(spark, d, ["author_id"]).where("author_id is not null").groupBy("tbl", "author_id").agg(F.count("*").alias("n"))
    c = a.groupBy("tbl", "n").agg(F.count("*").alias("c"))
    w = W.partitionBy("tbl")
    c = c.withColumns({"upto": F.sum("c").over(w.orderBy("n")), "all": F.sum("c").over(w)})
    return c.groupBy("tbl").agg(F.max("all").alias("authors"), F.min("n").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median"), F.round(F.sum(F.col("n") * F.col("c")) / F.max("all"), 2).alias("mean"), F.max("n").alias("most"))


def head_records(spark, d, k=100):
    """The first k human records in the order of their ids: a head limit."""
    return corpus(spark, d, ["source"]).where("tbl = 'human_texts'").orderBy("k").limit(k).select("id", "source")


# ---- filters and text rules


def known_authors(spark, d):
    """Records whose author or model is known."""
    return corpus(spark, d, ["author_id", "model"]).where("author_id is not null or model is not null").select("id")


def source_buckets(spark, d):
    """Records by the pool that their source is taken into; sources in none are left out."""
    bucket = None
    for name, sources in BUCKETS.items():
        here = F.col("source").isin(*sources)
        bucket = F.when(here, name) if bucket is None else bucket.when(here, name)
    return corpus(spark, d, ["source"]).select("id", bucket.alias("bucket")).where("bucket is not null")


def hard_labels(spark, d):
    """Each run line's label by its detector's own threshold and side, and how many lines it agrees with."""
    at, below = F.lit(0.5), F.lit(False)
    for name, (threshold, side) in THRESHOLDS.items():
        at, below = F.when(F.col("detector") == name, threshold).otherwise(at), F.when(F.col("detector") == name, side == "below").otherwise(below)
    s = scores(spark, d).withColumns({"_at": at, "_below": below})
    ai = F.when(F.col("_below"), F.col("y_score") < F.col("_at")).otherwise(F.col("y_score") >= F.col("_at")).cast("int")
    return s.withColumn("ai", ai).groupBy("detector").agg(F.count("*").alias("n"), F.sum("ai").alias("n_ai"), _n(F.col("ai") == F.col("y_pred")).alias("as_predicted"), _n(F.col("ai") == F.col("y_true")).alias("right"))


def distinct_rewrites(spark, d):
    """Texts and different texts that come, over any number of steps of one, from each source: rewrites and their humanized forms."""
    c = corpus(spark, d, ["src", "text_hash"]).where("src is not null and text_hash is not null")
    r = c.where("tbl = 'rewritten_texts'").select("k", "src", "text_hash")
    z = c.where("tbl = 'humanized_texts'").select(F.col("src").alias("k"), F.col("text_hash").alias("t")).join(r.select("k", "src"), "k").select("src", F.col("t").alias("text_hash"))
    return r.select("src", "text_hash").unionByName(z).groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("text_hash").alias("n_distinct"))


def longest_candidate(spark, d):
    """Of each source's rewrites the longest, of equals the one with the first key."""
    c = corpus(spark, d, ["src", "n_chars"]).where("tbl = 'rewritten_texts' and src is not null")
    return c.groupBy("src").agg(F.min_by("id", F.struct((-F.col("n_chars")).alias("n"), "k")).alias("id"), F.max("n_chars").alias("n_chars"))


def rewrite_similarity(spark, d, threshold=0.65):
    """Edit similarity of original and rewrite, 0 for a blank rewrite, and the label it gives: much alike is AI."""
    p = _pairs(spark, d).withColumn("t", T.strip("text"))
    sim = F.when(F.col("t") == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), T.edit_similarity("t", "orig"))))
    return p.select(F.col("k").alias("id"), F.round(sim + T.NUDGE, 6).alias("p_ai"), F.when(sim >= threshold, "ai").otherwise("human").alias("label"))


def acceptance_by_length(spark, d, least=20):
    """Rewrites of more than so many characters that differ from their original, and the others, by model."""
    c = corpus(spark, d, ["model", "src", "n_chars", "text_hash"])
    h = c.where("tbl = 'human_texts'").select(F.col("k").alias("src"), F.col("text_hash").alias("of"))
    j = c.where("tbl = 'rewritten_texts'").join(h, "src")
    ok = (F.col("n_chars") > least) & ~F.col("text_hash").eqNullSafe(F.col("of"))
    return j.groupBy("model").agg(_n(ok).alias("accepted"), _n(~ok).alias("rejected"))


def smoke_transform(spark, d):
    """Texts with a word in front, by hash."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("PARAPHRASED: "), T.text_of("text"))).alias("text_hash"))


def extractor_input(spark, d):
    """What an extractor gets: a blank for an empty or null text; by length and hash."""
    t = F.coalesce(F.nullif(T.text_of("text"), F.lit("")), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("n_chars"), F.md5(t).alias("text_hash"))


_T = lambda c: f"regexp_replace(coalesce({c}, ''), '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g')"
_MERGED = f"{_W}, {_SCORES}, m as (select s.*, c.tbl from s join corpus c on c.k = s.k where c.tbl in ('human_texts', 'humanized_texts')), o as (select k, row_number() over (order by k) as pos from (select distinct k from m))"
_A = f"{_W}, a as (select author_id, count(*) as n from corpus where author_id is not null group by 1)"
_AT = " ".join(f"when '{n}' then y_score {'<' if side == 'below' else '>='} {at}" for n, (at, side) in THRESHOLDS.items())
SQL = {
    "feature_metadata": f"""select vec_id, label, case when doc_id is null then 'missing_' || vec_id else coalesce(case when a not in ('unknown', 'anonymous', 'n/a') then a end, 'singleton_' || vec_id) end as author_id, coalesce(s, '?') as source
      from embeddings left join (select doc_id, {_K.format(c='author_id')} as a, {_K.format(c='source')} as s from documents) on doc_id = vec_id""",
    "cache_join": f"{_W}, {_SCORES} select split, count(*) as n, count(*) filter (k in (select k from s where k is not null)) as cached, count(*) filter (k not in (select k from s where k is not null)) as missing from corpus group by 1",
    "merged_evaluation": f"{_MERGED} select detector, pos, m.k, y_true, min(y_score) as y_score from m join o on o.k = m.k where (tbl = 'human_texts' and y_true = 0) or (tbl = 'humanized_texts' and y_true = 1) group by 1, 2, 3, 4",
    "quadruples": f"""{_W}, r as (select r.src, count(*) as z from corpus r join corpus z on z.src = r.k and z.tbl = 'humanized_texts' where r.tbl = 'rewritten_texts' group by 1), n as (select src, count(*) as n from corpus where tbl = 'rewritten_texts' group by 1)
      select id, coalesce(n.n, 0) as n_rewrites, coalesce(z, 0) as n_humanized, coalesce(z, 0) > 0 as complete from corpus c left join n on n.src = c.k left join r on r.src = c.k where c.tbl = 'human_texts' and c.source = 'arxiv'""",
    "author_members": f"{_W} select author_id, label, id from corpus where author_id is not null",
    "cluster_rows": f"{_W}, r as (select coalesce(src, k) as cluster_id, id from corpus where tbl = 'rewritten_texts') select *, 'rewrite' as role from r union all select k, id, 'source' from corpus where tbl = 'human_texts' and k in (select cluster_id from r)",
    "style_coverage": f"{_W}, h as (select source, k in (select src from corpus where tbl = 'rewritten_texts' and src is not null) as ok from corpus where tbl = 'human_texts') select case when grouping(source) = 1 then 'all' else 'source' end as what, source, count(*) as n, round(avg(ok::int) + 1e-9, 6) as coverage from h group by grouping sets ((source), ())",
    "counts_falling": f"{_W}, n as (select model, count(*) as n from corpus where model is not null group by 1) select model, n, row_number() over (order by n desc, model) as place from n",
    "author_bands": f"{_A} select count(*) as authors, count(*) filter (n <= 5) as few, count(*) filter (n >= 20) as many, coalesce(sum(n) filter (n >= 20), 0) as records_of_many from a",
    "author_head_tail": f"{_A} select * from (select 'head' as at, author_id, n from a order by n desc, author_id limit 20) union all select * from (select 'tail' as at, author_id, n from a order by n, author_id desc limit 20)",
    "author_medians": f"{_W}, a as (select tbl, author_id, count(*) as n from corpus where author_id is not null group by 1, 2) select tbl, count(*) as authors, min(n) as least, list_sort(list(n))[count(*) // 2 + 1] as median, round(avg(n), 2) as mean, max(n) as most from a group by 1",
    "head_records": f"{_W} select id, source from corpus where tbl = 'human_texts' order by k limit 100",
    "known_authors": f"{_W} select id from corpus where author_id is not null or model is not null",
    "source_buckets": f"{_W} select id, case " + " ".join(f"when source in {s} then '{n}'" for n, s in BUCKETS.items()) + " end as bucket from corpus where source in " + str(tuple(x for s in BUCKETS.values() for x in s)),
    "hard_labels": f"with {_SCORES}, l as (select *, (case detector {_AT} else y_score >= 0.5 end)::int as ai from s) select detector, count(*) as n, sum(ai) as n_ai, count(*) filter (ai = y_pred) as as_predicted, count(*) filter (ai = y_true) as \"right\" from l group by 1",
    "distinct_rewrites": f"{_W}, t as (select src, text from corpus where tbl = 'rewritten_texts' union all select r.src, z.text from corpus r join corpus z on z.src = r.k and z.tbl = 'humanized_texts' where r.tbl = 'rewritten_texts' and r.text is not null) select src, count(*) as n, count(distinct text) as n_distinct from t where src is not null and text is not null group by 1",
    "longest_candidate": f"{_W}, r as (select src, id, length(coalesce(text, '')) as n, row_number() over (partition by src order by length(coalesce(text, '')) desc, k) as r from corpus where tbl = 'rewritten_texts' and src is not null) select src, id, n as n_chars from r where r = 1",
    "rewrite_similarity": f"""{_W}, p as (select r.k as id, {_T('r.text')} as t, {edit_sql(_T('r.text'), 'h.text')} as e from corpus r join corpus h on h.k = r.src and h.tbl = 'human_texts' where r.tbl = 'rewritten_texts'),
      s as (select id, case when t = '' then 0.0 else greatest(0, least(1, 1 - e.edits / e.longer::double)) end as s from p) select id, round(s + 1e-9, 6) as p_ai, case when s >= 0.65 then 'ai' else 'human' end as label from s""",
    "acceptance_by_length": f"{_W}, j as (select r.model, length(coalesce(r.text, '')) > 20 and r.text is distinct from h.text as ok from corpus r join corpus h on h.k = r.src and h.tbl = 'human_texts' where r.tbl = 'rewritten_texts') select model, count(*) filter (ok) as accepted, count(*) filter (not ok) as rejected from j group by 1",
    "smoke_transform": "select doc_id, md5('PARAPHRASED: ' || coalesce(text, '')) as text_hash from documents",
    "extractor_input": "select doc_id, length(coalesce(nullif(text, ''), ' ')) as n_chars, md5(coalesce(nullif(text, ''), ' ')) as text_hash from documents",
    "roc_legend": f"{metrics._W}, {metrics._BY}, {metrics._AUC} select detector, auc, row_number() over (order by auc desc nulls last, detector) as place from auc",
    "strict_rate_order": f"with r as ({metrics.SQL['strict_fpr_roc']}) select detector, tpr, row_number() over (order by tpr desc nulls last, detector) as place from r",
    "positive_drop_share": f"{metrics._W}, {metrics._SETS}, {metrics._CVH}, x as (select detector, greatest(-coalesce(delta_f1, 0.0), 0.0) as l from v) select detector, round(case when sum(l) over () > 0 then l / sum(l) over () else 0.0 end + 1e-9, 5) as share from x",
    "sources_rising": f"with a as ({metrics.SQL['per_source_accuracy']}) select *, row_number() over (partition by detector order by source nulls first) as place from a",
}
QUERIES = {n: globals()[n] for n in SQL}
