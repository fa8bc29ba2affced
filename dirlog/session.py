"""Settings that the jobs of this library profit from, and tables that they share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes that a task reads of a shuffle or of files, at most, and the partitions that a shuffle starts from, at least, to
#: be joined up to that. From 201 on, Spark would hold what a task writes in memory.
TASK_BYTES, PARTITIONS = 16 << 20, 200


def tuned(spark: SparkSession) -> SparkSession:
    """For the owner of a session: settings under which parsing is fast, tasks stay small and times are shown in UTC.

    Parsing makes long methods: beyond 8,000 bytes the JVM would never compile them, so Spark is to split them.
    Events shrink to a tenth or less in a shuffle or in Parquet, and Spark deals tasks out by what is left: a task of its
    usual size holds many times that. So tasks are to be smaller, and enough of them, unless the session has them smaller yet.
    No operator needs these settings for its results, and none changes them.
    """
    conf = spark.conf
    conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    conf.set("spark.sql.session.timeZone", "UTC")
    for size in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        conf.set(size, min(TASK_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(size))))
    start = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    conf.set(start, max(PARTITIONS, int(conf.get(start, conf.get("spark.sql.shuffle.partitions")))))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); on a single machine a temporary one if none is set."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back, for what several steps read.

    The table outlives lost executors and is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
