"""Small helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space; bytes of non-ASCII letters stay.
WORDS_AZ = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Sessions and the Hadoop path strings that staged() wrote for them in this process.
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one that was set on the context.

    A folder of this machine is taken only under a local master, where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder: set it to one that all executors share")
        named = f"file://{tempfile.gettempdir()}/waymill-checkpoints"
        spark.sparkContext.setCheckpointDir(named)
    return named


def staged(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts the lineage, and survives the loss of any executor.

    by: a column of few values; reading some of them reads their files alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/waymill-{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_one(df: DataFrame) -> None:
    """Deletes a table that staged() gave, once another one that was made from it has been written."""
    path = getattr(df, "_staged_at", None)
    for own, at in [x for x in _written if x[1] == path]:
        p = SparkContext._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(own.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove((own, at))


def drop_staged(spark: SparkSession | None = None) -> None:
    """Deletes what staged() wrote for a session (or all): once a query's result is written, and when the process ends.

    Works after the session has been stopped too, with the configuration that the JVM finds by itself.
    """
    jvm = SparkContext._jvm
    for own, path in [x for x in _written if spark is None or x[0] is spark]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        live = own.sparkContext._jsc
        p.getFileSystem(live.hadoopConfiguration() if live else jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
        _written.remove((own, path))


@atexit.register
def _clean() -> None:
    with contextlib.suppress(Exception):  # the JVM has ended before; the cluster clears its checkpoint folder
        drop_staged()


def short_batches(spark: SparkSession, rows: int = 512, size: int = 32 << 20) -> None:
    """For applications (registered queries, the pipeline): texts go to Python in batches of so many rows and bytes at most.

    It bounds a worker's memory however long the texts of a partition are. Operators leave the session's settings alone.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        had = int(spark.conf.get(name).removesuffix("b"))
        if had <= 0 or had > most:
            spark.conf.set(name, most)


def with_columns_free(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns of the input whose names an operator is about to add (in any case), so that results are unambiguous."""
    gone = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in gone])


def whole_numbers(df: DataFrame, col: str) -> None:
    if (kind := dict(df.dtypes)[col]) not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{col} must hold whole numbers, not {kind}")


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with underscores before it until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return tuple(out)


def held(cols: list[str], df: DataFrame) -> list[str]:
    """Those of the columns that df has."""
    return [c for c in cols if c in df.columns]


def without(keep: list[str], *names: str) -> list[str]:
    """The columns to keep that do not clash (in any case) with those that an operator adds."""
    gone = {n.lower() for n in names}
    return [c for c in keep if c.lower() not in gone]


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256_of(col):
    return F.sha2(F.encode(col, "UTF-8"), 256)
