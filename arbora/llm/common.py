"""Helpers that the corpus operators share: shared storage, words, hashing, running sums."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space that separates words; bytes.split() cuts at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
GOLDEN = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder path below the one that driver and executors share.

    It is named by ``spark.checkpoint.dir``; only where that is unset and Spark runs in one
    process (tests) a temporary folder takes its place. On a cluster a missing setting raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="arbora-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/arbora-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder by Hadoop's own file systems; one that is gone is no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Folders made so far: session, path, and a weak reference to the index of files that every plan which reads the table holds (none for other files).
_made: list[tuple[SparkSession, str, object]] = []


@atexit.register
def _sweep() -> None:
    for spark, path, _ in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def made(spark: SparkSession, path: str, reader: object = None) -> None:
    """Remember a folder, to be deleted when nothing reads it any more, at the latest at the end."""
    _made.append((spark, path, reader))


def free_unused() -> None:
    """Delete tables that no plan refers to any more.

    Every DataFrame that derives from a table holds the table's file index in the JVM. When the
    JVM has collected that, no result can need the files: the rule Spark's own cleaner has for
    checkpoints. A table that is still to be read, by whatever result, stays.
    """
    for entry in list(_made):
        spark, path, reader = entry
        if reader is not None and spark.sparkContext._jsc is not None and reader.refersTo(None):
            _made.remove(entry)
            delete(spark, path)


def stored(df: DataFrame, max_rows: int = 0) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, survives lost executors."""
    free_unused()
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", max_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    made(spark, path, spark.sparkContext._jvm.java.lang.ref.WeakReference(files))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_count(rows: int, each: int) -> int:
    """Groups for so many rows; grows with the input."""
    return max(1, -(-rows // each))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A mixed 64-bit hash of each n consecutive words; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += h[k : k + m] * np.uint64(pow(GOLDEN, k + 1, 2**64))
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= MIX
    return h ^ (h >> np.uint64(32))


def lower_ascii(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def in_slices(batches, size: int = 512):
    """Record batches cut small, so that what is derived from long texts stays small too."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def running_sum(df: DataFrame, part: list[str], chunk: str, order: list, value: str, into: str) -> DataFrame:
    """Sum of ``value`` over the rows before, within ``part`` by (chunk, order).

    Two levels: sums of the chunks run over a table that is smaller by a chunk's
    rows, then each chunk runs in its own group. No task gets a whole part, however
    large it is. ``order`` must be total within a chunk, up to rows that are alike.
    """
    keys = [*part, chunk]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(sums, keys)
        .withColumn(into, F.col("_base") + F.coalesce(F.sum(value).over(own), F.lit(0)))
        .drop("_base")
    )
