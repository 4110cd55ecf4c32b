"""Tables of their own for rows that are read more than once."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

Keep = Callable[[DataFrame], DataFrame]


class NoSharedFolder(RuntimeError):
    pass


@functools.cache
def _local() -> str:
    return f"file://{tempfile.mkdtemp(prefix='keelson-')}"


def shared(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or if that is unset, with one machine only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise NoSharedFolder("Error: spark.checkpoint.dir has to name a folder that the driver and all executors share.")
    return f"{(base or _local()).rstrip('/')}/keelson-{uuid.uuid4().hex}"


@contextlib.contextmanager
def dealt(spark: SparkSession, tasks: int) -> Iterator[Keep]:
    """A keeper under which rows are shuffled to so many tasks, none of them joined beyond a few MB; the settings hold for what runs inside."""
    names = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield keeper(spark)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def keeper(spark: SparkSession) -> Keep:
    """Writes rows to a new shared folder and reads them back."""
    shared(spark)  # fails early where there is none

    def keep(rows: DataFrame) -> DataFrame:
        path = shared(spark)
        rows.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    return keep
