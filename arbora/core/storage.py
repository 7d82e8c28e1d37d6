"""Cutting a plan by the folder that driver and executors share, and how many tasks its rows are dealt to."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint: later plans begin there, and lost executors take nothing with them.

    The folder is Spark's own (``spark.checkpoint.dir``); only where that is unset and Spark runs in
    one process a temporary one takes its place. Spark's cleaner removes the files when no plan
    refers to them any more, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` says so.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="arbora-"))
    return df.checkpoint(eager=True)


def pieces(df: DataFrame, of: int = 2 << 20, most: int = 4096) -> int:
    """How many partitions to deal the rows to: one for each ``of`` bytes of the input as it is stored.

    At least as many as there are cores; as many as Spark's shuffles have if it does not know an
    input's size. Given to repartition, the number stays as it is, so that a task's memory does not
    grow with the input, while Spark joins partitions of its own by their compressed bytes, of which
    texts may have few. Beyond ``most`` partitions they grow.
    """
    spark, leaves = df.sparkSession, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes, default=0) >= int(spark.conf.get("spark.sql.defaultSizeInBytes", str(2**63 - 1)).rstrip("bB")):
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(min(-(-sum(sizes) // of), most), spark.sparkContext.defaultParallelism)
