"""Readers and writers over whole tables: each query writes a table in a format, reads it back and gives what came."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.keys import key, split_name, text_records
from corpusloom.session import own_folder, table
from corpusloom.sources import io


def _path(spark, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _records(spark, d, name: str = "human_texts") -> DataFrame:
    return table(spark, d, name).select(*[f.name for f in io.CORPUS.fields])


def _shown(df: DataFrame) -> DataFrame:
    """What is compared: the fields, the text by its hash."""
    return df.select("id", F.md5("text").alias("text_hash"), "is_ai", "label", "source", "author_id", "source_text_id", "text_length_words", "split")


def jsonl_scan(spark, d):
    """Human records as JSON lines, read with a given schema; a bad line would stop it."""
    path = _path(spark, "jsonl")
    io.write_jsonl(_records(spark, d), path)
    return _shown(io.read_jsonl(spark, path))


def jsonl_scan_checked(spark, d):
    """The same, all lines checked before any is used."""
    path = _path(spark, "jsonl")
    io.write_jsonl(_records(spark, d, "ai_texts"), path)
    return _shown(io.read_jsonl(spark, path, bad="report"))


def jsonl_missing_file(spark, d):
    """Two files of which one isn't there; empty strings as null."""
    path = _path(spark, "jsonl")
    io.write_jsonl(_records(spark, d), path)
    return _shown(io.cleaned(io.read_jsonl(spark, [path, path + "-absent"], missing_ok=True)))


def jsonl_torn_line(spark, d):
    """Lines of which some are torn or blank: they are left out."""
    path = _path(spark, "lines")
    whole = io.json_lines(_records(spark, d))
    torn = whole.select(F.expr("substring(value, 1, 20)").alias("value")).unionByName(whole.select(F.lit("").alias("value")))
    whole.unionByName(torn).write.text(path)
    return _shown(io.read_jsonl(spark, path, bad="drop"))


def csv_round_trip(spark, d):
    """Authors and texts with quotes and line ends in them, by way of CSV."""
    path = _path(spark, "csv")
    io.write_csv(_records(spark, d).where("text is not null and text <> ''").select("id", F.translate("text", "\r", "").alias("text")), path)
    return io.read_csv(spark, path, io.T.StructType(io.CORPUS.fields[:2])).select("id", F.length("text").alias("n_chars"))


def split_folders(spark, d):
    """One folder for each split, of which one is read."""
    path = _path(spark, "splits")
    rows = text_records(spark, d, ["id", "split"]).select("tbl", "id", split_name("split").alias("split"))
    io.write_splits(rows, path)
    return io.read_splits(spark, path, "test", rows.schema).select("tbl", "id")


def first_file_wins(spark, d):
    """Rows of several tables by key, of the first table that has it."""
    frames = [table(spark, d, t).where("id is not null").groupBy(key("id").alias("id")).agg(F.min("source").alias("source")) for t in ("humanized_texts", "rewritten_texts", "human_texts")]
    frames.append(frames[1].select("id", F.lit("again").alias("source")))
    return io.first_wins(frames).select("id", "source")


def feature_defaults(spark, d):
    """A feature table without ids, sources and marks: the index and defaults stand in, and only ids asked for are kept."""
    path = _path(spark, "features")
    table(spark, d, "embeddings").orderBy("vec_id").coalesce(1).select("vec_id", "label").write.parquet(path)
    keep = spark.range(0, 100000, 3).select(F.col("id").cast("string").alias("id"))
    return io.read_features(spark, path, keep).select("id", "source", "style_ok", "vec_id", "label")


def result_folder(spark, d):
    """Results by detector, a JSON file each, their names from the files'."""
    from corpusloom.operators.metrics import confusion_f1

    path = _path(spark, "results")
    for name in sorted(r["detector"] for r in confusion_f1(spark, d).select("detector").collect()):  # one row a detector
        one = f"{path}-parts/{name}"
        io.json_lines(confusion_f1(spark, d).where(F.col("detector") == name).select("accuracy", "macro_f1")).coalesce(1).write.text(one)
        jvm = spark._jvm.org.apache.hadoop.fs
        fs = jvm.Path(one).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(jvm.Path(path))
        part = next(s.getPath() for s in fs.listStatus(jvm.Path(one)) if s.getPath().getName().startswith("part"))
        fs.rename(part, jvm.Path(f"{path}/run__{name}.json"))
    schema = io.T.StructType([io.T.StructField(c, io.T.DoubleType()) for c in ("accuracy", "macro_f1")])
    if not io.exists(spark, path):
        return spark.createDataFrame([], "detector string, accuracy double, macro_f1 double")
    return io.read_results(spark, path, schema, "run").select("detector", "accuracy", "macro_f1")


def resumed(spark, d):
    """What is left to do: rewritten records that no humanized record names."""
    todo = table(spark, d, "rewritten_texts").select(key("id").alias("id")).where("id is not null").distinct()
    return io.pending(todo, table(spark, d, "humanized_texts").select(key("source_text_id").alias("id")))


_K = "nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"
_SHOWN = "id, md5(text) as text_hash, is_ai, label, source, author_id, source_text_id, text_length_words, split"
SQL = {
    "jsonl_scan": f"select {_SHOWN} from human_texts",
    "jsonl_scan_checked": f"select {_SHOWN} from ai_texts",
    "jsonl_missing_file": f"select id, md5(text) as text_hash, is_ai, label, source, nullif(author_id, '') as author_id, nullif(source_text_id, '') as source_text_id, text_length_words, nullif(split, '') as split from human_texts",
    "jsonl_torn_line": f"select {_SHOWN} from human_texts",
    "csv_round_trip": "select id, length(replace(text, chr(13), '')) as n_chars from human_texts where text <> '' and replace(text, chr(13), '') <> ''",
    "split_folders": " union all ".join(f"select '{t}' as tbl, id from {t} where {_K.format(c='split')} = 'test'" for t in ("human_texts", "ai_texts", "rewritten_texts", "humanized_texts")),
    "first_file_wins": "with a as (" + " union all ".join(f"select {i} as r, {_K.format(c='id')} as id, source from {t} where id is not null" for i, t in enumerate(("humanized_texts", "rewritten_texts", "human_texts"))) + "), f as (select id, r, min(source) as source from a group by 1, 2) select id, arg_min_null(source, r) as source from f group by 1",
    "feature_defaults": "with o as (select vec_id, label, row_number() over (order by vec_id) - 1 as i from embeddings) select i::varchar as id, '?' as source, false as style_ok, vec_id, label from o where i % 3 = 0 and i < 100000",
    "resumed": f"select distinct {_K.format(c='id')} as id from rewritten_texts where {_K.format(c='id')} is not null and {_K.format(c='id')} not in (select {_K.format(c='source_text_id')} from humanized_texts where {_K.format(c='source_text_id')} is not null)",
}
QUERIES = {n: globals()[n] for n in [*SQL, "result_folder"]}
