"""Session helpers: a local session for tests and benches, and the shared folder for written tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made for local sessions without a setting, by application.
_own: dict[str, str] = {}
#: Folders of written tables, by application.
_folders: dict[str, str] = {}


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session on local[cores]; on a cluster the caller's own session is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        found = _own[app]
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the program ends, or by clear_written()."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/corpusloom-{app}"
        atexit.register(_removed, spark, _folders[app])
    return _folders[app]


def _removed(spark: SparkSession, folder: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has ended before: the folder stays
        pass


def clear_written(spark: SparkSession) -> None:
    """Deletes all tables that this application has written: call it when no frame made so far is used any more."""
    _removed(spark, own_folder(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt over all cores; a larger one as it is.

    For expressions that cost far more than moving a row. What is moved is at most a split for each core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder sf_dir."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
