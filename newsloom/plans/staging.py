"""Intermediate tables and size-checked broadcasts.

Multi-pass jobs cut their lineage with tables written to the folder the cluster
names in ``spark.checkpoint.dir``. A lost executor then costs the current stage
only, and the planner knows the true size of what it joins next.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bound for anything sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024

_FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4,
    T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    # One machine only, as in tests.
    folder = tempfile.mkdtemp(prefix="newsloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with Parquet's ``options``, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsloom/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/newsloom/"
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if f"/newsloom/{folder.rsplit('/', 1)[1]}" in folder and root.split(":", 1)[-1].lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _width(kind: T.DataType, column) -> tuple[int, list]:
    """Fixed bytes of a value, and expressions for its variable bytes."""
    if type(kind) in _FIXED_WIDTH:
        return _FIXED_WIDTH[type(kind)], []
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 8, [F.octet_length(column)]
    if isinstance(kind, T.ArrayType) and type(kind.elementType) in _FIXED_WIDTH:
        return 16, [F.size(column) * _FIXED_WIDTH[type(kind.elementType)]]
    if isinstance(kind, T.StructType):
        parts = [_width(f.dataType, column[f.name]) for f in kind.fields]
        return 16 + sum(n for n, _ in parts), [x for _, xs in parts for x in xs]
    # Anything else by the length of its JSON form.
    return 16, [F.octet_length(F.to_json(F.struct(column)))]


def measured_bytes(df: DataFrame) -> int:
    """Size of a staged table in memory: row count, fixed and summed variable widths."""
    fixed, variable = _width(df.schema, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    extra = sum((F.coalesce(x, F.lit(0)) for x in variable), F.lit(0).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(extra).alias("b")).first()
    return int(row["n"] * (32 + fixed) + (row["b"] or 0))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a staged table whose measured size is under ``limit``.

    Beyond it the table is returned unhinted, and Spark joins by shuffle with
    adaptive skew handling.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def dealt(df: DataFrame) -> DataFrame:
    """A scan dealt out anew if the session says so, else as it is.

    ``newsloom.scanPartitions`` is for tables of one row group on one machine, which Spark
    can't split; a cluster session leaves it unset, and texts are read where they are.
    """
    partitions = df.sparkSession.conf.get("newsloom.scanPartitions", None)
    return df.repartition(int(partitions)) if partitions else df
