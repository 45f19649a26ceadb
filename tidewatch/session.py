"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidewatch-"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def need_local(master: str) -> None:
    """A cluster's executors cannot see the driver's folders."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder named in spark.checkpoint.dir.

    Streams keep their offsets, state and output there, so that a lost executor
    or a restarted driver finds them again. Only a local session may leave the setting
    out; a local folder is then made and recorded.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        need_local(spark.conf.get("spark.master", "local"))
        base = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df, name: str, codec: str | None = None):
    """Write a bounded intermediate result to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables) -> None:
    """Delete tables that `cut_lineage` wrote, once nothing reads them any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
