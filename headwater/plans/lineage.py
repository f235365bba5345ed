"""Cutting lineage and staging tables so that a lost executor never loses work.

Everything goes to the shared folder the session names in ``spark.checkpoint.dir``; only a session in local mode
(tests, a laptop) may do without one and gets a local folder. Staged tables are deleted when the
program ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode a fresh local one if the session names none, elsewhere an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="headwater-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once and read back from the shared folder.

    A checkpoint keeps its plan's size estimate; in a loop of joins the estimates multiply until they overflow.
    So the rows are wrapped anew, without an estimate.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)
    plain = spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    return DataFrame(plain, spark)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is scanned in fewer partitions than that; inputs of many files stay as they are.

    A plan with a shuffle of its own is left alone: its partitions are AQE's, and asking for their number would
    run it.
    """
    query = df._jdf.queryExecution()
    if query.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if query.toRdd().getNumPartitions() >= wanted else df.repartition(wanted)


def stage(df: DataFrame) -> DataFrame:
    """As :func:`cut`, as a compressed columnar table: for wider rows than a checkpoint should hold."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(_delete_staged)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete_staged() -> None:
    """Deletes the staged tables of sessions that still run (a stopped one has no file system to ask)."""
    for spark, path in _staged:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001 - the session, its JVM or its folder may be gone by now
            continue
