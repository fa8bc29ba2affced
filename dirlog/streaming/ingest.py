"""Incremental runs: new complete files are parsed, their partial tables merged into the saved state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlog.plans.events import read_events
from dirlog.session import stored
from dirlog.sources import state as S


def parse_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return read_events(spark, paths)


def ingest_batch(spark: SparkSession, paths: list[str], state_dir: str, generation: int, previous: int | None = None, batch: str = "") -> str:
    """Parses the files, merges with generation ``previous`` of the state, writes ``generation``; returns its path.

    A generation is never written over, so a run that breaks off leaves the one before whole.
    """
    events = stored(parse_paths(spark, paths))
    tables = S.partials(events)
    if previous is not None:
        old = S.load_state(spark, f"{state_dir}/{previous}")
        S.refuse_foreign(events, old)
        tables = S.merge_states(old, tables)
    S.save_state(tables, path := f"{state_dir}/{generation}", batch)
    return path


def watch(spark: SparkSession, folder: str, state_dir: str, checkpoint: str):
    """A stream over complete files that appear in ``folder``: each micro-batch is one ``ingest_batch``."""

    def step(batch: DataFrame, epoch: int) -> None:
        # Generations go on from what the folder holds, whatever the stream's own count says after a new checkpoint;
        # a batch that is tried again writes its own generation once more. A generation that is not whole is passed by.
        paths = [r[0] for r in batch.select("file").distinct().collect()]
        if not paths:
            return
        found = {int(p): S.scheme(spark, f"{state_dir}/{p}") for p in generations(spark, state_dir)}
        mine = f"{checkpoint}#{epoch}"
        again = [g for g, v in found.items() if v and v[1] == mine]
        generation = again[0] if again else max(found, default=-1) + 1
        ingest_batch(spark, paths, state_dir, generation, max((g for g, v in found.items() if v and g < generation), default=None), mine)

    # Only the listing is read; the content column is pruned.
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select(F.col("path").alias("file"))
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def generations(spark: SparkSession, state_dir: str) -> list[str]:
    """Names of the generations under the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
