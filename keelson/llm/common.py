"""Small helpers that several of the operators share."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, for Java's and DuckDB's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="keelson-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder, under the one the cluster names in spark.checkpoint.dir, that executors and driver share.

    Where the setting is absent, as in local tests, a temporary folder of this machine takes its place; on a cluster,
    whose executors wouldn't share that, it is an error. The folder goes when the driver's process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = local_dir()
    path = f"{base.rstrip('/')}/keelson-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        return


def keep(df: DataFrame, path: str, *, compression: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, so a lost executor costs no recomputation."""
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*cols: str):
    """128 bits that stand for the values of a row; equal rows share it, and nulls differ from every value."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x00", *parts)))


def slices(table: pa.RecordBatch, column: str, least: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Slices of a batch with about `least` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(table.column(column)), 0), np.int64)
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + least, "right")))
        yield start, end
        start = end
