"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("stammwerk")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def any_session() -> SparkSession:
    """The session that is there, or the one that spark-submit or the defaults configure; without a master, a local one."""
    if SparkSession.getActiveSession() is not None or "PYSPARK_SUBMIT_ARGS" in os.environ or "SPARK_ENV_LOADED" in os.environ:
        return SparkSession.builder.appName("stammwerk").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return get_session()


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a local master; elsewhere an error, as
    a folder of one machine would lose rows."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="stammwerk-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, whichever Spark can reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or null where there is none."""
    place, system = _place(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    place, system = _place(spark, path)
    stream = system.create(place, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        place, system = _place(spark, path)
        system.delete(place, True)
    except Exception:  # the session may be gone by then
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage; they outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/stammwerk-{label}-{uuid.uuid4().hex[:12]}"
        self.written = 0  # number of the last table
        atexit.register(_delete, spark, self.path)

    def write(self, df: DataFrame) -> DataFrame:
        """Write df and read it back; the new plan starts at the files."""
        self.written += 1
        path = f"{self.path}/{self.written}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, number: int) -> None:
        """Delete the table of that number once nothing reads it any more."""
        _delete(self.spark, f"{self.path}/{number}")
