"""Features of texts and vectors: surface and readability statistics, similarity of rewrites, TF-IDF sentences, vector blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import text as T
from corpusloom.keys import first_arrivals, key, text_records
from corpusloom.operators.corpus import CORPUS, edit_sql
from corpusloom.session import spread, table

_W = f"with {CORPUS}"
#: Fixed value: sentences of an author's text that stand for it.
PRINCIPAL = 5


def _texts(spark, d, tables: tuple[str, ...]) -> DataFrame:
    """k and text of each record of some tables (text is part of the aggregate, so only for queries that need it beyond the scan)."""
    rows = text_records(spark, d, ["id", "text", "author_id", "source_text_id", "ingested_at"]).where(F.col("tbl").isin(*tables))
    from corpusloom.keys import author

    rows = rows.select("tbl", key("id").alias("k"), F.col("ingested_at").alias("at"), author("author_id").alias("author_id"), key("source_text_id").alias("src"), "text")
    return first_arrivals(rows.where("k is not null"), "k", "at", ["at", "tbl", "author_id", "src", "text"])


def surface_stats(spark, d):
    c = spread(table(spark, d, "documents").select("doc_id", "text"))
    return c.select("doc_id", *[v.alias(k) for k, v in T.surface("text").items()])


def readability(spark, d):
    c = spread(table(spark, d, "documents").select("doc_id", "text"))
    return c.select("doc_id", *[v.alias(k) for k, v in T.readability("text").items()])


def _pairs(spark, d) -> DataFrame:
    """Rewrites beside their original: k, src, text, orig. An original is one row, so a hot one splits on the rewrites' side."""
    t = _texts(spark, d, ("rewritten_texts", "human_texts"))
    h = t.where("tbl = 'human_texts'").select(F.col("k").alias("src"), F.col("text").alias("orig"))
    return t.where("tbl = 'rewritten_texts'").select("k", "src", "text").join(h, "src")


def similarities(p: DataFrame) -> DataFrame:
    """p (k, src, text, orig) with id, src, jaccard_1, _2, _3 (sets of n-grams in lower case, split at white space) and edit_similarity."""
    words = p.select("k", "src", T.tokens(F.lower("text")).alias("a"), T.tokens(F.lower("orig")).alias("b"), F.round(T.edit_similarity("text", "orig"), 6).alias("edit_similarity"))
    return words.select(F.col("k").alias("id"), "src", *[F.round(T.jaccard(T.ngrams(F.col("a"), n), T.ngrams(F.col("b"), n)), 6).alias(f"jaccard_{n}") for n in (1, 2, 3)], "edit_similarity")


def ngram_jaccard(spark, d):
    return similarities(_pairs(spark, d)).select("id", "jaccard_1", "jaccard_2", "jaccard_3")


def edit_similarity(spark, d):
    return similarities(_pairs(spark, d)).select("id", "edit_similarity")


def style_vector(spark, d):
    """Per original: mean and population deviation over its rewrites of the n-gram and edit similarities; zeros without rewrites."""
    r = similarities(_pairs(spark, d))
    names = ["jaccard_1", "jaccard_2", "jaccard_3", "edit_similarity"]
    s = r.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), *[F.round(F.avg(n) + T.NUDGE, 5).alias(f"mean_{n}") for n in names], *[F.round(F.stddev_pop(n) + T.NUDGE, 5).alias(f"std_{n}") for n in names])
    ids = text_records(spark, d, ["id"]).where("tbl = 'human_texts'").select(key("id").alias("id")).where("id is not null").distinct()
    every = ids.join(s, "id", "left")
    return every.select("id", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in s.columns if c not in ("id", "n")], F.col("n").isNotNull().alias("style_ok"))


def _sentences(spark, d) -> DataFrame:
    """author_id, k, pos, sentence of human records with an author: split at full stops, blank ones dropped; pos and sentence are null for a text without any."""
    t = _texts(spark, d, ("human_texts",)).where("author_id is not null")
    parts = F.filter(F.transform(F.split(T.text_of("text"), r"\."), T.strip), lambda s: s != "")
    return t.select("author_id", "k", F.posexplode_outer(parts).alias("pos", "sentence"))


def tfidf_sentences(spark, d):
    """Sum of the L2-normalised tf-idf weights of each sentence, fitted on its author's texts; terms are words of two characters or more, in any script.

    One row a term, aggregated before each shuffle; a large author is many (author, term) groups.
    """
    return _scored(_sentences(spark, d)).select("author_id", F.col("k").alias("id"), "pos", "score")


def _scored(s: DataFrame) -> DataFrame:
    terms = s.select("author_id", "k", "pos", F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit(f"([{T.WORD}]{{2,}})"), F.lit(1))).alias("term"))
    tf = terms.groupBy("author_id", "k", "pos", "term").agg(F.count("*").alias("tf"))
    df = tf.select("author_id", "term", "k").distinct().groupBy("author_id", "term").agg(F.count("*").alias("df"))
    n = s.select("author_id", "k").distinct().groupBy("author_id").agg(F.count("*").alias("n"))
    w = tf.join(df, ["author_id", "term"]).join(n, "author_id").withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    score = w.groupBy("author_id", "k", "pos").agg((F.sum("w") / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("score"))
    return s.where("pos is not null").join(score, ["author_id", "k", "pos"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 5))


def principal_text(spark, d):
    """Each text's five sentences of highest score in the order of the score (ties by position), and their positions."""
    r = _scored(_sentences(spark, d)).withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(F.desc("score"), "pos"))).where(F.col("r") <= PRINCIPAL)
    best = F.array_sort(F.collect_list(F.struct("r", "pos", "sentence")))
    joined = lambda c: F.array_join(F.transform(best, lambda x: x[c].cast("string")), " ")
    return r.groupBy(F.col("k").alias("id")).agg(joined("pos").alias("positions"), joined("sentence").alias("principal"))


# ---- vectors


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


def cosine_to_mean(spark, d):
    """Cosine of each vector and the mean of its label's vectors; the means are one row a label."""
    e = _vectors(spark, d)
    m = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return e.join(m, "label").select("vec_id", "label", F.round(T.cosine(F.col("embedding"), F.col("mean")), 5).alias("cosine"))


def mean_embedding(spark, d):
    e = _vectors(spark, d).select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def normalizer_fit(e: DataFrame) -> DataFrame:
    """dim, mean, std (population; 1 where below 1e-6) of the columns of an array column `embedding`."""
    x = e.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    return x.select("dim", "mean", F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd")).alias("std"))


def normalizer_stats(spark, d):
    return normalizer_fit(_vectors(spark, d)).select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def normalizer_transform(spark, d):
    """Vectors standardised by what even ids were fitted to; summed up by id so that a row stays a row."""
    e = _vectors(spark, d)
    fit = normalizer_fit(e.where("vec_id % 2 = 0"))  # the training half of a hold-out, applied to all
    state = fit.orderBy("dim").collect()  # as many rows as a vector is wide
    mean, std = (F.array(*[F.lit(float(r[c])) for r in state]) for c in ("mean", "std"))
    z = F.zip_with(F.zip_with("embedding", mean, lambda x, m: x.cast("double") - m), std, lambda x, s: x / s)
    return e.select("vec_id", F.round(F.aggregate(z, F.lit(0.0), lambda a, b: a + b), 4).alias("sum_z"), F.round(F.array_max(z), 4).alias("max_z"))


def fit_width(spark, d):
    """Vectors cleaned of NaN and cut or filled to widths 10 and 80."""
    e = _vectors(spark, d).select("vec_id", T.clean(F.col("embedding")).alias("x"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 5)
    short, long = T.fit_width(F.col("x"), 10), T.fit_width(F.col("x"), 80)
    return e.select("vec_id", F.size(short).alias("n_short"), total(short).alias("sum_short"), F.size(long).alias("n_long"), total(long).alias("sum_long"))


#: Stand-in blocks of the vectors: name, first (1-based), width.
BLOCKS = (("nela", 1, 32), ("style", 33, 10), ("trace", 43, 22))


def block_importance(spark, d):
    """Share of each block in the sum of absolute mean weights by label."""
    m = mean_embedding(spark, d).select("label", F.col("dim") + 1, F.abs("mean").alias("w")).toDF("label", "i", "w")
    block = F.lit(None).cast("string")
    for name, first, width in BLOCKS:
        block = F.when(F.col("i").between(first, first + width - 1), name).otherwise(block)
    b = m.groupBy("label", block.alias("block")).agg(F.sum("w").alias("w"))
    return b.select("label", "block", F.round(F.col("w") / F.sum("w").over(W.partitionBy("label")), 5).alias("share"))


def block_stats(spark, d):
    """Rows that aren't all zero, mean, population deviation, least and most of each block."""
    e = _vectors(spark, d)
    out = None
    for name, first, width in BLOCKS:
        b = e.select("vec_id", F.slice("embedding", first, width).alias("b"))
        x = b.select(F.exists("b", lambda v: v != 0).alias("nz"), F.explode("b").alias("x"))
        one = x.agg(F.lit(name).alias("block"), F.round(F.sum(F.col("nz").cast("double")) / width, 2).alias("rows_nonzero"), F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"), F.round(F.stddev_pop(F.col("x").cast("double")), 5).alias("std"), F.round(F.min("x").cast("double"), 5).alias("least"), F.round(F.max("x").cast("double"), 5).alias("most"))
        out = one if out is None else out.unionByName(one)
    return out


_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
_SENTS = f"greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+(?:[{T.SPACE}]+|$)'), lambda s: regexp_matches(s, '[^{T.SPACE}]'))), 1)"
_PUNCT = "[\\.,;:!?\\-\"''()\\[\\]]"
_TOK = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[^{T.SPACE}]+')"
_NG = lambda a, n: f"list_distinct(case when len({a}) >= {n} then list_transform(range(1, len({a}) - {n} + 2), lambda i: array_to_string(list_slice({a}, i, i + {n} - 1), ' ')) else [] end)"
_JAC = lambda a, b: f"case when len({a}) = 0 and len({b}) = 0 then 1.0 else len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::double end"
_SIM = f"""{_W}, o as (select r.k, r.src, {_TOK('r.text')} as a, {_TOK('h.text')} as b, {edit_sql('r.text', 'h.text')} as e from corpus r join corpus h on h.k = r.src and h.tbl = 'human_texts' where r.tbl = 'rewritten_texts'),
  g as (select k, src, {_NG('a', 1)} as a1, {_NG('b', 1)} as b1, {_NG('a', 2)} as a2, {_NG('b', 2)} as b2, {_NG('a', 3)} as a3, {_NG('b', 3)} as b3, e from o),
  s as (select k as id, src, round({_JAC('a1', 'b1')}, 6) as jaccard_1, round({_JAC('a2', 'b2')}, 6) as jaccard_2, round({_JAC('a3', 'b3')}, 6) as jaccard_3, round(case when e.longer = 0 then 0.0 else 1 - e.edits / e.longer::double end, 6) as edit_similarity from g)"""
_NAMES = ["jaccard_1", "jaccard_2", "jaccard_3", "edit_similarity"]
_TFIDF = f"""{_W}, q as (select author_id, k, list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda s: regexp_replace(s, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g')), lambda s: s <> '') as l from corpus where tbl = 'human_texts' and author_id is not null),
  s as (select author_id, k, unnest(range(len(l)))::int as pos, unnest(l) as sentence from q), t as (select author_id, k, pos, unnest(regexp_extract_all(lower(sentence), '[{T.WORD}]{{2,}}')) as term from s),
  tf as (select author_id, k, pos, term, count(*) as tf from t group by all), df as (select author_id, term, count(distinct k) as df from tf group by all), n as (select author_id, count(*) as n from q group by 1),
  w as (select tf.author_id, tf.k, tf.pos, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (author_id, term) join n using (author_id)),
  sc as (select author_id, k, pos, sum(w) / sqrt(sum(w * w)) as score from w group by all), f as (select s.author_id, s.k as id, s.pos, s.sentence, round(coalesce(score, 0.0), 5) as score from s left join sc using (author_id, k, pos))"""
_LETTERS = "length(array_to_string(ws, ''))"
_ANY = lambda x: f"case when len(ws) > 0 then round({x} + 1e-9, 6) else 0.0 end"
_DIMS = "x as (select label, vec_id, unnest(range(len(embedding)))::int as dim, unnest(embedding)::double as v from embeddings)"
SQL = {
    "surface_stats": f"with w as (select *, regexp_extract_all(coalesce(text, ''), '[{T.WORD}]+') as ws, {_SENTS} as sents from documents) select doc_id, len(ws) as n_words, length(coalesce(text, '')) as n_chars, sents as n_sents, {_ANY(_LETTERS + ' / len(ws)')} as avg_word_len, round(len(ws) / sents, 6) as avg_sent_len, {_ANY('len(list_distinct(list_transform(ws, lambda v: lower(v)))) / len(ws)')} as type_token_ratio, {_ANY(f'''len(regexp_extract_all(coalesce(text, ''), '{_PUNCT}')) / len(ws)''')} as punct_rate from w",
    "readability": f"""with w as (select *, regexp_extract_all(coalesce(text, ''), '\\p{{L}}+') as ws, {_SENTS} as sents from documents) select doc_id, {_ANY(f'5.88::double * {_LETTERS} / len(ws) - 29.6::double * sents / len(ws) - 15.8::double')} as coleman_liau, {_ANY('len(ws) / sents + 100.0::double * len(list_filter(ws, lambda v: length(v) > 6)) / len(ws)')} as lix, {_ANY(f'4.71::double * {_LETTERS} / len(ws) + 0.5::double * len(ws) / sents - 21.43::double')} as ari,
      {_ANY("len(list_filter(ws, lambda v: lower(v) in ('the', 'a', 'an', 'of', 'to', 'in', 'and', 'is', 'it', 'that', 'for', 'on', 'with', 'as', 'was'))) / len(ws)")} as stop_rate, {_ANY('len(list_filter(ws, lambda v: length(v) > 1 and upper(v) = v and lower(v) <> v)) / len(ws)')} as caps_rate, {_ANY("len(regexp_extract_all(coalesce(text, ''), '!')) / len(ws)")} as exclaim_rate, {_ANY("len(regexp_extract_all(coalesce(text, ''), '\"')) / len(ws)")} as quote_rate from w""",
    "ngram_jaccard": f"{_SIM} select id, jaccard_1, jaccard_2, jaccard_3 from s",
    "edit_similarity": f"{_SIM} select id, edit_similarity from s",
    "style_vector": f"{_SIM}, v as (select src as id, count(*) as n, " + ", ".join(f"round(avg({n}) + 1e-9, 5) as mean_{n}, round(stddev_pop({n}) + 1e-9, 5) as std_{n}" for n in _NAMES) + " from s group by 1) select c.k as id, coalesce(v.n, 0) as n, " + ", ".join(f"coalesce(mean_{n}, 0.0) as mean_{n}, coalesce(std_{n}, 0.0) as std_{n}" for n in _NAMES) + ", v.n is not null as style_ok from corpus c left join v on v.id = c.k where c.tbl = 'human_texts'",
    "tfidf_sentences": f"{_TFIDF} select author_id, id, pos, score from f",
    "principal_text": f"{_TFIDF}, r as (select id, pos, sentence, row_number() over (partition by id order by score desc, pos) as r from f) select id, string_agg(pos::varchar, ' ' order by r) as positions, string_agg(sentence, ' ' order by r) as principal from r where r <= {PRINCIPAL} group by 1",
    "cosine_to_mean": f"with {_DIMS}, m as (select label, dim, avg(v) as m from x group by 1, 2), l as (select label, list(m order by dim) as mean from m group by 1) select vec_id, e.label, round({_DOT('embedding', 'mean')} / (sqrt({_DOT('embedding', 'embedding')}) * sqrt({_DOT('mean', 'mean')})), 5) as cosine from embeddings e join l on l.label = e.label",
    "mean_embedding": f"with {_DIMS} select label, dim, round(avg(v), 6) as mean from x group by 1, 2",
    "normalizer_stats": f"with {_DIMS} select dim, round(avg(v), 6) as mean, round(case when stddev_pop(v) < 1e-6 then 1.0 else stddev_pop(v) end, 6) as std from x group by 1",
    "normalizer_transform": f"with {_DIMS}, f as (select dim, avg(v) as m, case when stddev_pop(v) < 1e-6 then 1.0 else stddev_pop(v) end as sd from x where vec_id % 2 = 0 group by 1) select vec_id, round(sum((v - m) / sd), 4) as sum_z, round(max((v - m) / sd), 4) as max_z from x join f using (dim) group by 1",
    "fit_width": f"with {_DIMS} select vec_id, 10 as n_short, round(sum(v) filter (dim < 10), 5) as sum_short, 80 as n_long, round(sum(v), 5) as sum_long from x group by 1",
    "block_importance": f"with {_DIMS}, m as (select label, dim + 1 as i, abs(round(avg(v), 6)) as w from x group by 1, 2), b as (select label, case when i between 1 and 32 then 'nela' when i between 33 and 42 then 'style' else 'trace' end as block, sum(w) as w from m group by 1, 2) select label, block, round(w / sum(w) over (partition by label), 5) as share from b",
    "block_stats": f"with {_DIMS}, b as (select case when dim < 32 then 'nela' when dim < 42 then 'style' else 'trace' end as block, vec_id, v from x), z as (select block, vec_id, bool_or(v <> 0) as nz from b group by 1, 2), c as (select block, round(count(*) filter (nz)::double, 2) as rows_nonzero from z group by 1) select block, rows_nonzero, round(avg(v), 5) as mean, round(stddev_pop(v), 5) as std, round(min(v), 5) as least, round(max(v), 5) as most from b join c using (block) group by 1, 2",
}
QUERIES = {n: globals()[n] for n in SQL}
