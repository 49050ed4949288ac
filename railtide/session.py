"""Session helpers: local sessions for tests, the shared folder, and broadcasts of a measured size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its values take at most this many bytes.
BROADCAST_BYTES = 32 << 20


def local_session(cores: int | str = 4, partitions: int = 8, app: str = "railtide") -> SparkSession:
    """A local session as used by tests and bench.py; on a cluster pass your own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one for a local session where that is unset.

    On a cluster a folder must be named: a temporary one would be another on every machine."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="railtide-")
        sc.setCheckpointDir(named)
        known = sc.getCheckpointDir()
    if known not in _ours:  # Spark makes a folder of its own in the one that was named, for this application alone
        _ours.add(known)
        atexit.register(_remove, spark, known)
    return known.rstrip("/")


_ours: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: the folder's owner cleans up
        pass


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder, which outlives lost executors and goes when the driver exits."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut, in Parquet: for large steps, of which later ones read only some columns. Keeps no placement of rows."""
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def value_bytes(kind: T.DataType, c: Column) -> Column:
    """About how many bytes a value takes: strings and arrays by their lengths, strings within arrays as 24 bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((value_bytes(f.dataType, c[f.name]) for f in kind.fields), F.lit(8))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c), F.lit(0)) * _element_bytes(kind) + 16
    return F.lit(8)


def _element_bytes(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return 8 + sum(_element_bytes(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return _element_bytes(kind.keyType) + _element_bytes(kind.valueType)
    return _element_bytes(kind.elementType) if isinstance(kind, T.ArrayType) else 24 if isinstance(kind, T.StringType) else 8


def total_bytes(df: DataFrame) -> int:
    """About how many bytes the values of a table take."""
    return df.agg(F.sum(value_bytes(T.StructType(df.schema.fields), F.struct(*df.columns)))).first()[0] or 0


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Checkpoint a dimension, measure it, and hint a broadcast only up to so many bytes; beyond, Spark shuffles."""
    df = cut(df)
    return F.broadcast(df) if total_bytes(df) <= most else df
