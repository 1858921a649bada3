"""What several operators need: reading tables, cutting lineage, sizing shuffles, keeping Python workers small."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java and RE2 character class: exactly the bytes that ``bytes.split()`` splits on.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own, in local mode only: other machines wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="metalith-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage: a lost executor costs no recomputation of it."""
    path = f"{shared_dir(df.sparkSession)}/metalith-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, *others: str) -> str:
    """A column name that clashes with none of ``df``."""
    taken = {c.lower() for c in df.columns} | {c.lower() for c in others}
    return next(n for i in range(10_000) if (n := f"_m{i}") not in taken)


#: What this Python worker keeps from task to task: one thing at a time.
_KEPT: dict = {}


def kept_by_worker(key, build: Callable):
    """``build()``, kept for later tasks of this worker until another key is asked for or a step asks for a lean worker."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def lean(run: Callable, keep: bool = False) -> Callable:
    """``run`` for mapInArrow, in a worker that first drops what other steps kept (unless ``keep``) and last gives free memory back.

    Workers live on between tasks and stages, so without this an executor's memory would be the sum of the greatest needs of all steps."""

    def bounded(batches):
        if not keep:
            _KEPT.clear()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return bounded
