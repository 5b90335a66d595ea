"""Readers and writers: JSON lines with four ways to meet bad lines, CSV, Parquet, feature tables, result folders, resume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

_S = T.StringType()
#: The fields of a corpus record; humanized records have two more.
CORPUS = T.StructType(
    [
        T.StructField("id", _S), T.StructField("text", _S), T.StructField("is_ai", T.BooleanType()), T.StructField("label", _S), T.StructField("source", _S), T.StructField("domain", _S), T.StructField("author_id", _S),
        T.StructField("model", _S), T.StructField("exam_type", _S), T.StructField("prompt", _S), T.StructField("source_text_id", _S), T.StructField("text_length_words", T.IntegerType()), T.StructField("split", _S),
    ]
)
HUMANIZED = T.StructType([*CORPUS.fields, T.StructField("humanizer", _S), T.StructField("humanizer_model", _S)])
#: Columns in which an empty string means null.
EMPTY_IS_NULL = ("split", "domain", "author_id", "model", "source_text_id")


class CorruptLines(ValueError):
    """Lines that are no JSON: how many, and file, line number and text of the first."""


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = CORPUS, *, bad: str = "fail", missing_ok: bool = False) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, unknown fields ignored, absent ones null.

    bad: "fail" stops at a line that is no JSON, "drop" leaves it out (a torn last line), "report" raises CorruptLines
    before anything is used. missing_ok: a path that isn't there gives an empty frame.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if missing_ok:
        paths = [p for p in paths if exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], schema)
    if bad == "report":
        lines = numbered(spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))).where(F.trim("value") != "")
        parsed = lines.select("value", "_file", "_line", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", _S)]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
        n, first = parsed.where(F.col("r._bad").isNotNull()).agg(F.count("*"), F.min(F.struct("_file", "_line", "value"))).first()
        if n:
            raise CorruptLines(f"{n} lines are no JSON; the first is line {first['_line']} of {first['_file']}: {first['value'][:200]!r}")
        return parsed.select("r.*").drop("_bad")
    return spark.read.schema(schema).option("mode", {"fail": "FAILFAST", "drop": "DROPMALFORMED"}[bad]).json(paths)


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of text files (value, _file, _start: where the block read begins) with _line, from 1 in each file; blank lines count.

    A block's lines are numbered as they are read; only a block's number of lines is shuffled.
    """
    rows = lines.withColumn("_n", F.monotonically_increasing_id())
    blocks = rows.groupBy("_file", "_start").agg(F.count("*").alias("_c"), F.min("_n").alias("_first"))
    blocks = blocks.withColumn("_before", F.sum("_c").over(W.partitionBy("_file").orderBy("_start")) - F.col("_c")).drop("_c")
    return rows.join(F.broadcast(blocks), ["_file", "_start"]).withColumn("_line", F.col("_before") + F.col("_n") - F.col("_first") + 1).drop("_n", "_first", "_before", "_start")


def with_index(df: DataFrame, name: str) -> DataFrame:
    """df with the 0-based index of its rows in the order in which it is read; only partitions' row counts are shuffled."""
    rows = df.withColumn("_n", F.monotonically_increasing_id())
    part = F.shiftright("_n", 33)
    counts = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).drop("_c")  # one row a partition
    return rows.join(F.broadcast(before), part == F.col("_p")).withColumn(name, F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).drop("_n", "_p", "_before")


def cleaned(df: DataFrame) -> DataFrame:
    """Empty strings as null in the columns for which that holds."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in EMPTY_IS_NULL if c in df.columns})


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A table partitioned by split: one split (other folders aren't scanned) or all. With a schema it may be empty."""
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_features(spark: SparkSession, path: str, keep: DataFrame | None = None, *, strict: bool = False) -> DataFrame:
    """A feature table; absent columns are filled (id by the row's index, source '?', style_ok false); with keep, only those ids.

    strict: an absent column raises.
    """
    df = spark.read.option("mergeSchema", True).parquet(path)
    absent = [c for c in ("id", "source", "style_ok") if c not in df.columns]
    if strict and absent:
        raise ValueError(f"{path} lacks " + ", ".join(absent))
    if "id" in absent:
        df = with_index(df, "_i").withColumn("id", F.col("_i").cast("string")).drop("_i")
    fill = {"source": F.lit("?"), "style_ok": F.lit(False)}
    for name, value in fill.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df if keep is None else df.join(keep.select("id").distinct(), "id", "left_semi")


def first_wins(frames: list[DataFrame], key: str = "id") -> DataFrame:
    """The union of frames with one row for each key: of the first frame that has it."""
    tagged = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = W.partitionBy(key).orderBy("_rank", *[c for c in every.columns if c not in (key, "_rank") and not isinstance(every.schema[c].dataType, T.MapType)])
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def read_results(spark: SparkSession, folder: str, schema: T.StructType, prefix: str = "") -> DataFrame:
    """A folder of JSON results by detector: the file's name without prefix__ and suffix; unreadable files are skipped."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return df.withColumn("detector", F.regexp_replace(name, f"^{prefix}__", "") if prefix else name)


def listing(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """Names in a folder that end so, without the suffix, sorted; none where the folder isn't there."""
    if not exists(spark, folder):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(n[: len(n) - len(suffix)] for n in names if n.endswith(suffix))


def backed_up(spark: SparkSession, path: str) -> str | None:
    """Moves what is at the path aside before it is written anew: to path.bak, .bak1 ...; None where there is nothing."""
    if not exists(spark, path):
        return None
    n, to = 0, f"{path}.bak"
    while exists(spark, to):
        n, to = n + 1, f"{path}.bak{n + 1}"
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(p, jvm.Path(to)):
        raise OSError(f"{path} can't be moved to {to}")
    return to


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as a line of JSON in a column `value`; nulls are kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def pending(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What is left to do: rows of todo whose key isn't in done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """One folder for each split; rows without one go to a folder of their own."""
    df.write.mode(mode).partitionBy("split").format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table as text; for small results only, it raises beyond `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"
