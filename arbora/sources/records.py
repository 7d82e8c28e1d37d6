"""Text records: lines of log files put together to records, by a regular expression with named groups.

A line that matches starts a record; lines that do not are added to the last group of the
record before them in the same file. Large files are read in splits: a line's number is its
place in its split with the lines of the splits before, and so is the number of its record.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.core.storage import pieces
from arbora.functions.text import group_list

#: Formats by name (fixed values): one named group for each column, the last takes what follows.
FORMATS = {
    "tomcat.log": r"(?<timestamp>[-:,T0-9]+) +(?<level>[A-Z]+) (?<thread>[^:]+) (?<class>[^:]*):(?<line>[^ ]*) - (?<message>.*)",
    "iiq.log": r"A,(?<timestamp>[-:.T0-9]+),(?<level>[A-Z]+),iam,app,\[(?<thread>[^\]]+)\]-\((?<class>[^:]*):(?<line>[^\)]*)\):(?<message>.*)",
    "batch.log": r"A,(?<timestamp>[-+:.T0-9]+),(?<level>[A-Z]+),(?<server>[^,]+),iiq-batch,(?<job>[^,]+),(?<message>.*)",
    "access.log": r'(?<client>[^ ]+)[^\[]+\[(?<timestamp>[^\]]+)\] *"(?<method>[A-Z]+)? *(?<path>[^"]*)" *(?<status>[0-9]+) *(?<length>.+)',
    "apache-error.log": r"\[(?<timestamp>[^\]]+)\] *\[(?<category>[^\]]+)\] *\[pid *(?<pid>[^:]+):tid *(?<tid>[^\]]+)\] *\[client *(?<client>[^\]]+)\] *(?<error>[^:]+): *(?<message>.*)",
    "meminfo.log": r"\[(?<timestamp>[^]]+)\] host = (?<host>[^ ]+) / max memory = (?<max>[^ ]+) / total memory = (?<total>[^ ]+) / free memory = (?<free>[^ ]+) / used memory = (?<used>[^ ]+) / available memory = (?<available>[^ ]+) / cpu load = (?<cpu>[^ ]+) %",
    "properties": r"(?<key>[^=]+)=(?<value>.*)(?<overflow>.*)",
    "plain": r"(?<line>.*)",
}


def format_of(path: str) -> str:
    """The format's name from a file's: without folder, date stamps and .gz."""
    name = path.rsplit("/", 1)[-1]
    return re.sub(r"[-.][-0-9]+(?=\.|$)", "", re.sub(r"\.gz$", "", name))


def lines(spark: SparkSession, paths: list[str] | str, most_files: int = 100) -> DataFrame:
    """path, split, pos, line. Globs and .gz go by Hadoop; more than ``most_files`` files raise unless it is 0."""
    read = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", r"\r$", "").alias("line"), F.monotonically_increasing_id().alias("_at"))
    if most_files and (n := len(read.inputFiles())) > most_files:
        raise ValueError(f"{n} files; at most {most_files} without most_files=0")
    # lines of a split lie in one partition, in order; a row a split says where it begins
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = read.groupBy("path", "split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return read.join(splits, ["path", "split"]).select("path", "split", (F.col("_at") - F.col("_first") + F.col("_base")).alias("pos"), "line")


def records(df: DataFrame, parser: str, start: str = "", stop: str = "", keep: str = "", skip: int = 0, most: int = 0, with_path: bool = False, strict: int = 10_000, in_order: bool = True) -> DataFrame:
    """Records from (path, pos, line) rows, and ``split`` if a path's rows are to be numbered by several tasks.

    ``parser``: a format's name or a pattern. Lines before the first that has ``start`` and after
    the first that has ``stop`` (itself included in the sample) are left out, in each file.
    ``keep``: records whose first line has it. An error if no line of ``strict`` matches.
    Records come in the order of files and lines, unless ``in_order`` is false, as before a union.
    Lines are dealt to as many tasks as the input's size asks for (``pieces``), so is every later step.
    """
    pattern = FORMATS.get(parser, parser)
    whole = f"^(?:{pattern})$"
    groups = [(name, k) for k, (name, _) in enumerate(group_list(pattern), 1) if name]
    # names of its own, as a pattern's groups may have any
    in_splits = "split" in df.columns
    df = df.select(F.col("path").alias("_path"), (F.col("split") if in_splits else F.lit(0)).alias("_split"), F.col("pos").alias("_pos"), F.col("line").alias("_line")).where(F.col("_pos") >= skip)
    n = pieces(df)
    df = df.repartition(n, "_path", "_split") if in_splits else df.repartition(n, "_path")
    for found, side in ((start, "from"), (stop, "to")):
        if found:
            first = df.where(F.col("_line").rlike(found)).groupBy("_path").agg(F.min("_pos").alias("_first"))
            df = df.join(first, "_path", "inner" if side == "from" else "left")
            df = df.where("_pos >= _first" if side == "from" else "_first IS NULL OR _pos <= _first").drop("_first")
    df = df.withColumn("_head", F.col("_line").rlike(whole))
    # the number of a line's record: heads in its split so far, and those of the splits before
    own = Window.partitionBy("_path", "_split").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_n", F.sum(F.col("_head").cast("int")).over(own))
    if in_splits:
        before = Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
        heads = df.groupBy("_path", "_split").agg(F.max("_n").alias("_heads"))
        heads = heads.select("_path", "_split", F.coalesce(F.sum("_heads").over(before), F.lit(0)).alias("_base"))
        df = df.join(heads, ["_path", "_split"]).withColumn("_n", F.col("_base") + F.col("_n")).drop("_base")
    if strict:
        none = (F.col("_n") == 0) & (F.col("_pos") >= strict + skip)
        df = df.withColumn("_n", F.when(none, F.raise_error(F.lit(f"no line of {strict} matches"))).otherwise(F.col("_n")))
    df = df.where("_n > 0")
    if in_splits:
        df = df.repartition(n, "_path", "_n")
    grouped = df.groupBy("_path", "_n").agg(
        F.min("_pos").alias("_pos"), F.min_by("_line", "_pos").alias("_first"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("_pos", "_line")))), lambda s: s["_line"]).alias("_more"),
    )
    if keep:
        grouped = grouped.where(F.col("_first").rlike(keep))
    parts = [F.regexp_extract("_first", whole, k) for _, k in groups]
    cols = [F.nullif(p, F.lit("")).alias(name) for p, (name, _) in zip(parts, groups, strict=True)]
    last = F.concat_ws("\n", parts[-1], F.when(F.size("_more") > 0, F.array_join("_more", "\n"))).alias(groups[-1][0])
    out = grouped.select("_path", "_pos", *cols[:-1], last)
    if most:
        out = out.orderBy("_path", "_pos").limit(most)
    elif in_order:
        out = out.repartitionByRange(n, "_path", "_pos").sortWithinPartitions("_path", "_pos")
    return out.drop("_pos").withColumnRenamed("_path", "_") if with_path else out.drop("_path", "_pos")


def parse_files(spark: SparkSession, paths: list[str] | str, parser: str = "", **options) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else paths
    parser = parser or format_of(paths[0])
    return records(lines(spark, paths, options.pop("most_files", 100)), parser, with_path=len(paths) > 1, **options)
