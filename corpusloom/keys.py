"""Keys as columns: ids, references, authors and splits compare trimmed of white space and without case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import table

TEXT_TABLES = ("human_texts", "ai_texts", "rewritten_texts", "humanized_texts")
#: Stand-ins for "no author".
NO_AUTHOR = ("unknown", "anonymous", "n/a")
#: Other spellings of the splits.
SPLIT_NAMES = {"training": "train", "validation": "val", "dev": "val"}


def stripped(c: Column | str) -> Column:
    """The value without white space at either end (Unicode), null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def key(c: Column | str) -> Column:
    """An id, reference or author in the form in which it is compared."""
    return F.lower(stripped(c))


def author(c: Column | str) -> Column:
    """An author's key; null for null, blank and the stand-ins for no author."""
    k = key(c)
    return F.when(~k.isin(*NO_AUTHOR), k)


def split_name(c: Column | str) -> Column:
    """train, val, test or null; other spellings are mapped, other words kept in lower case."""
    k = key(c)
    return reduce(lambda e, p: e.when(k == p[0], p[1]), SPLIT_NAMES.items(), F.when(k.isNull(), None)).otherwise(k)


def text_records(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """`tbl` and the columns named, of all rows of the four text tables; only those columns are scanned."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), *columns) for t in TEXT_TABLES]
    return reduce(DataFrame.unionByName, parts)


def first_arrivals(df: DataFrame, key_col: str, time_col: str, keep: list[str]) -> DataFrame:
    """One row per key: the columns in `keep` of its first arrival (ties: the smallest values).

    Aggregates before the shuffle, so rows sent twice and hot keys cost no more than distinct keys.
    """
    first = F.min(F.struct(time_col, *[c for c in keep if c != time_col])).alias("_f")
    return df.groupBy(key_col).agg(first).select(key_col, *[F.col(f"_f.{c}").alias(c) for c in keep])
