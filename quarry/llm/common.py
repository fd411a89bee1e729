"""What the training-data operators share: word rules, scratch tables and worker set-up."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The six ASCII white-space characters that separate words.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: The same class for Spark's regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text as UTF-8: maximal runs without the six white-space characters; none for null.

    ``lower`` lower-cases A-Z only. On bytes both are Python's own operations: in UTF-8
    no other character has a byte below 128.
    """
    if not isinstance(text, str):
        return []
    return text.encode().lower().split() if lower else text.encode().split()


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, and makes sure that checkpoints have a folder.

    All that is in it goes when the process ends. The folder is the session's ``spark.checkpoint.dir``. Only where that is unset, and
    the master is local, a temporary folder is made; a cluster must name a shared one.
    """
    sc = spark.sparkContext
    if _ROOT not in sc.environment.get("PYTHONPATH", "").split(":"):
        sc.environment["PYTHONPATH"] = ":".join(x for x in (_ROOT, sc.environment.get("PYTHONPATH", "")) if x)
    named = sc.getConf().get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        if not named and sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named := named or tempfile.mkdtemp(prefix="quarry-checkpoints-"))
    own = sc.getCheckpointDir()  # a folder of this application alone, within the one that is named
    if own not in _CLEARED and named and own.rpartition("/")[0].rstrip("/").endswith(named.rpartition(":")[2].rstrip("/")):
        _CLEARED.add(own)
        atexit.register(_delete, spark, own)
    return spark


#: Folders that go when the process ends.
_CLEARED: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shield(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` whose columns with a leading underscore, but for ``used``, have other names; and how to rename them back."""
    own = {c: f"kept{k}{c}" for k, c in enumerate(docs.columns) if c.startswith("_") and c not in used}
    return docs.withColumnsRenamed(own), {new: old for old, new in own.items()}


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of a task; before each, and at the end, freed memory goes back to the system.

    Python workers outlive their task. What their allocators keep would count against the
    executor's memory in all later stages.
    """
    _trim()
    for pdf in batches:
        yield pdf
        del pdf
        _trim()


class Scratch:
    """Parquet tables in the shared checkpoint folder, for one operator call.

    ``keep`` writes a table and reads it back, which cuts lineage: a lost executor
    costs a re-read, never a recomputation of what made the table. ``drop`` deletes
    what no later step reads, ``finish`` does so for all: for narrow results.
    """

    def __init__(self, spark: SparkSession):
        self.spark = ready(spark)
        self.base = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.base)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df``, written and read again; ``by``: a column with few values, a folder for each."""
        path = f"{self.base}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, df: DataFrame) -> DataFrame:
        """The result, as a checkpoint; all tables go. Checkpoints go with the process, or once unused if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
        out = df.checkpoint()
        self.drop()
        return out

    def drop(self, *names: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for path in [f"{self.base}/{n}" for n in names] or [self.base]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def parts_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Deals rows over the session's shuffle partitions, by key if any is given."""
    return df.repartition(parts_for(df), *keys)


def crc_mod(id_col: str, n: int):
    """crc32 of an id written as text, modulo n, as a Column."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)
