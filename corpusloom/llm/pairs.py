"""Broken prompt and response pairs: each with one type of defect, or none.

Pairs are rewritten records with their instruction and the original they name, and AI answers with their question. The
answer is held against both: nothing in it, a refusal, a copy, another language; and against the corpus: cut off. For
the last, responses are sorted among those that begin alike and compared with their neighbours, lengths at which many
are cut are found, and the endings are judged by all texts (see cut.py). Languages are told apart by profiles fitted on
labelled documents (languages.py). An original that many rewrites name is one row
on its side of the join, so adaptive execution can split the rewrites of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.keys import key, stripped
from corpusloom.llm import cut
from corpusloom.llm.answers import defect
from corpusloom.llm.languages import Languages, fitted
from corpusloom.session import table


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, id, at, model, text, prompt, and src for rewritten records; src is null for questions and their answers."""
    cols = [key("id").alias("k"), stripped("id").alias("id"), F.col("ingested_at").alias("at"), stripped("model").alias("model"), "text", "prompt"]
    rewritten = table(spark, sf_dir, "rewritten_texts").select(*cols, key("source_text_id").alias("src"), F.lit(True).alias("rewrite"))
    answered = table(spark, sf_dir, "ai_texts").where("prompt is not null").select(*cols, F.lit(None).cast("string").alias("src"), F.lit(False).alias("rewrite"))
    return rewritten.unionByName(answered).where("k is not null")


def _classify(languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, original, prompt, rewrite = (batch.column(c).to_pylist() for c in ("text", "original", "prompt", "rewrite"))
            kinds = [defect(t, o, p, o if r else p, languages.value) for t, o, p, r in zip(text, original, prompt, rewrite, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "id", "at", "model")), pa.array(kinds, pa.string())], ["k", "id", "at", "model", "defect"])

    return run


def judged(rows: DataFrame, originals: DataFrame, truncated: DataFrame, languages: Languages | None = None) -> DataFrame:
    """k, id, model and defect (null for a whole pair) of each pair; a key that came more than once, as it came first.

    rows: as pairs() gives them; originals: k, at, text; truncated: k; languages: None if none could be fitted, then none
    is another. An answer may be null, empty or of any length. A pair without an original is only held against its
    prompt, and has no other language. Of the defects the first of empty, refusal (unless it is a copy), copy,
    other_language and truncated holds. Empty tables give an empty result.
    """
    rows = rows.select("k", "id", "at", "model", "text", "prompt", "src", "rewrite").where("k is not null")
    orig = originals.where("k is not null").groupBy("k").agg(F.min(F.struct("at", "text"))["text"].alias("original")).withColumnRenamed("k", "src")
    # pairs that name no original would all meet in one task of the join
    alone = rows.where("src is null").withColumn("original", F.lit(None).cast("string"))
    both = rows.where("src is not null").join(orig, "src", "left").unionByName(alone)
    seen = both.select("k", "id", "at", "model", "text", "original", "prompt", "rewrite").mapInArrow(_classify(rows.sparkSession.sparkContext.broadcast(languages)), "k string, id string, at timestamp, model string, defect string")
    first = seen.groupBy("k").agg(F.min(F.struct("at", "id", "model", "defect")).alias("f")).select("k", "f.id", "f.model", "f.defect")
    short = truncated.select("k").distinct().withColumn("short", F.lit("truncated"))
    return first.join(short, "k", "left").select("k", "id", "model", F.coalesce("defect", "short").alias("defect"))


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    originals = cut.originals(spark, sf_dir)
    truncated = cut.truncated(cut.records(spark, sf_dir), originals).select(key("id").alias("k"))
    return judged(pairs(spark, sf_dir), originals, truncated, fitted(table(spark, sf_dir, "documents")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).where("defect is not null").select("id", "defect")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model: pairs and how many of each defect."""
    kinds = ["empty", "refusal", "copy", "other_language", "truncated"]
    return _all(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n_pairs"), *[F.count(F.when(F.col("defect") == d, 1)).alias(d) for d in kinds])


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL: dict[str, str] = {}
