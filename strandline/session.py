"""Spark sessions with the settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(app: str = "strandline", **settings: str) -> SparkSession:
    """Get or create a session; keyword settings use double underscores for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where none is set, as in local tests, a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, few_files: bool = False) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it from there.

    Executors may be lost at any later time: the table is whole and all can read it. Spark removes the
    shuffle files of a finished query at once; ``release`` removes the table, else it goes when the
    application ends. ``few_files`` lets Spark gather what many tasks made into files of its advisory
    size; use it where the last step has no shuffle whose partitions could be merged.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.shuffleDependency.fileCleanup.enabled", "true")
    # a union that keeps its inputs' partitioning fails where Spark merges their partitions differently at run time
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    path = f"{shared_folder(spark)}/strandline-{uuid.uuid4().hex}"
    out = (df.hint("rebalance") if few_files else df).write.option("compression", "zstd")
    out.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    folder, store = _store(spark, path)
    store.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``cut_lineage`` wrote and that nothing reads any more."""
    for df in tables:
        folder, store = _store(df.sparkSession, df.written_to)
        store.delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder, store = _store(spark, path)
    return store.exists(folder)


def _store(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
