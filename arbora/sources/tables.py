"""Sources: tables with filter and order, assembled SQL, directories, registered functions, formats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.text import clob
from arbora.lang.filters import compile_filter
from arbora.operators.ordered import sort_keys

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def scan(spark: SparkSession, path: str, where: str = "", ordering: str = "", fmt: str = "parquet", **options) -> DataFrame:
    """A stored table; the filter text becomes a Column, so that the scan gets it."""
    df = spark.read.format(fmt).options(**options).load(path)
    if where:
        df = df.where(compile_filter(where))
    return df.orderBy(*sort_keys(*ordering.split(","))) if ordering else df


def attributes(df: DataFrame, names: str, extended: str | None = None) -> DataFrame:
    """Regular columns and keys of the extended map by name; a clash goes to the map; "" is the whole map."""
    out = []
    for n in (x.strip() for x in names.split(",") if x.strip()):
        plain = F.col(n) if n.split(".")[0] in df.columns else None
        more = F.try_element_at(F.col(extended), F.lit(n)) if extended else None
        value = F.coalesce(more, plain.cast("string")) if plain is not None and more is not None else plain if plain is not None else more
        out.append(value.alias(n))
    return df.select(*(out or [F.explode(extended).alias("key", "value")]))


def sql(spark: SparkSession, columns: str, tables: str, where: str = "", group_by: str = "", having: str = "", order_by: str = "", max_rows: int = 0, max_clob: int = 0, args: dict | None = None) -> DataFrame:
    """Clauses put together; long texts are cut at ``max_clob``."""
    clauses = (("WHERE", where), ("GROUP BY", group_by), ("HAVING", having), ("ORDER BY", order_by))
    text = f"SELECT {columns} FROM {tables}" + "".join(f" {k} {v}" for k, v in clauses if v)
    df = spark.sql(text, args or None)
    if max_clob:
        df = df.withColumns({c: clob(F.col(c), max_clob) for c, t in df.dtypes if t == "string"})
    return df.limit(max_rows) if max_rows else df


def directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, type, lastModified, length (kB) of a folder's entries, folders first, by any Hadoop file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(p, pattern)) or []
    rows = [(s.getPath().getName(), "directory" if s.isDirectory() else "file", s.getModificationTime(), s.getLen()) for s in found]
    df = spark.createDataFrame(rows, "name string, type string, ms long, bytes long")
    return df.select("name", "type", F.timestamp_millis("ms").alias("lastModified"), F.ceil(F.col("bytes") / 1024).alias("length")).orderBy("type", "name")


def register(name: str):
    """A function of (spark, **parameters) that gives a DataFrame, as a named source."""

    def add(f):
        REGISTRY[name] = f
        return f

    return add


def call(spark: SparkSession, name: str, **parameters) -> DataFrame:
    return REGISTRY[name](spark, **parameters)


def connector(spark: SparkSession, fmt: str, path: str | None = None, max_objects: int = 0, **overrides) -> DataFrame:
    """Any data source by its format name, with overrides as options."""
    df = spark.read.format(fmt).options(**overrides).load(path)
    return df.limit(max_objects) if max_objects else df


#: Applications by name: a data source's format, the folder or table prefix its kinds lie below, and options.
APPLICATIONS: dict[str, tuple[str, str, dict]] = {}


def application(name: str, fmt: str, root: str, **options) -> None:
    APPLICATIONS[name] = fmt, root, options


def resources(spark: SparkSession, name: str, kind: str, **overrides) -> DataFrame:
    """The objects of one kind in a registered application; overrides go before its own options."""
    fmt, root, options = APPLICATIONS[name]
    return connector(spark, fmt, f"{root.rstrip('/')}/{kind}" if kind else root, **(options | overrides))


@dataclass
class Reference:
    """Where a dotted name leads: rows, the column that names them (or an array of such), and their key."""

    rows: DataFrame
    by: str
    key: str


def attributes_joined(df: DataFrame, names: str, references: dict[str, Reference]) -> DataFrame:
    """Columns by name; ``ref.name`` joins the referenced rows, outer: a row without any stays, with null, and one with several stands for each."""
    wanted = [x.strip() for x in names.split(",") if x.strip()]
    for ref in dict.fromkeys(n.split(".")[0] for n in wanted if "." in n):
        r = references[ref]
        own = f"_{ref}"
        by = F.explode_outer(r.by) if dict(df.dtypes)[r.by].startswith("array") else F.col(r.by)
        fields = list(dict.fromkeys(n.split(".", 1)[1] for n in wanted if n.startswith(f"{ref}.")))
        rows = r.rows.select(F.col(r.key).alias(own), F.struct(*fields).alias(f"_of_{ref}"))
        df = df.withColumn(own, by).join(rows, own, "left")
    return df.select(*(F.col(f"_of_{n.split('.')[0]}")[n.split(".", 1)[1]].alias(n) if "." in n else F.col(n) for n in wanted))


def literals(spark: SparkSession, *values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], ["value"])


def numbers(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    return spark.range(start, stop, step).withColumnRenamed("id", "value")
