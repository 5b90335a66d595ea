"""Incremental ingest: new files of records are appended once by key, late repeats within the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.session import shared_dir


def record_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8, fmt: str = "parquet") -> DataFrame:
    """The files of a folder, or one file by its folder and name, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).load(p.getParent().toString())
    return reader.load(folder)


def append_once(stream: DataFrame, out: str, checkpoint: str, *, key: str = "id", time: str = "ingested_at", delay: str = "30 days") -> StreamingQuery:
    """Appends each key's first row to a Parquet table; state for a key is dropped when the watermark has passed it.

    All files there are read, then the query ends; started again, it goes on behind them.
    """
    once = stream.where(F.col(key).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, *, time: str = "ingested_at", width: str = "30 days", delay: str = "1 day", by: str = "source") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def streamed_ingest(spark: SparkSession, d: str) -> DataFrame:
    """human_texts through append_once: id and split of each record that was appended."""
    import uuid

    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    path = f"{d}/human_texts.parquet"
    schema = spark.read.parquet(path).schema
    stream = record_stream(spark, path, schema).select("id", "split", "ingested_at")
    append_once(stream, f"{base}/out", f"{base}/checkpoint", delay="3650 days").awaitTermination()
    return spark.read.schema("id string, split string, ingested_at timestamp").parquet(f"{base}/out").select("id")


QUERIES = {"streamed_ingest": streamed_ingest}
SQL = {"streamed_ingest": "select distinct id from human_texts where id is not null"}
