"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode only, which goes when the process ends."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, forget: bool = False) -> DataFrame:
    """The same rows from a reliable checkpoint: computed once, safe when an executor is lost.  The columns are new ones to Catalyst,
    so that the rows can be joined with what they come from.  Spark removes the files of a checkpoint that nothing refers to
    any more where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.

    A checkpoint keeps the size that Catalyst estimated for its plan.  Over rounds of joins these estimates multiply, until
    numbers of millions of digits take longer than the work; with ``forget`` the size is unknown from here on, for use in rounds.

    What was shuffled for the rows isn't needed once they are written; it goes at once, else it stays until the driver collects its garbage."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.select("*").checkpoint()  # a new query, since each takes the setting when it is made
    finally:
        spark.conf.set(CLEANUP, before)
    if forget:
        out = DataFrame(spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False), spark)
    return out.select(*[F.col(f"`{c}`").alias(c) for c in out.columns])


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with places 0, 1, ... in an order, without a window over all rows: ranges are numbered on their own, and each
    range begins where the counts of those before it end."""
    placed = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = sorted((r["__p"], r["n"]) for r in placed.groupBy("__p").agg(F.count("*").alias("n")).collect())  # one row a partition
    begin, rows = 0, []
    for p, n in counts:
        rows.append((p, begin))
        begin += n
    starts = df.sparkSession.createDataFrame(rows, "__p int, __b long")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return placed.withColumn(name, own.cast("long") - 1).join(F.broadcast(starts), "__p").withColumn(name, F.col(name) + F.col("__b")).drop("__p", "__b")
