"""What the operators share: tables, the shared folder and staged tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir; where a
    local session names none (tests), a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame, kind: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there,
    so a lost executor costs at most the tasks that it ran."""
    path = scratch(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one partition of a narrow table takes.
NARROW = 200_000


def sized(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    """A staged narrow table in as many partitions as its rows call for, and its rows:
    a small one takes part in joins and sums without a shuffle."""
    rows = df.count() if rows is None else rows
    return df.coalesce(max(1, -(-rows // NARROW))), rows


def total(df: DataFrame, what) -> int:
    """A sum over the whole table, as one row."""
    return int(df.agg(F.sum(what)).first()[0] or 0)


def released(f):
    """``f``, after which memory that it no longer uses goes back to the machine: a
    Python worker lives on between tasks and would keep it."""

    def wrapped(*args):
        import pyarrow as pa

        held()
        out = f(*args)
        pa.default_memory_pool().release_unused()
        _trim()
        return out

    return wrapped


_held: dict[str, dict] = {}


def held(owner: str = "") -> dict:
    """What a Python worker keeps for one operator between tasks. Workers outlive stages
    and operators, so what others kept goes."""
    others = [k for k in _held if k != owner]
    for k in others:
        del _held[k]
    if others:
        _trim()
    return _held.setdefault(owner, {}) if owner else {}


#: Bytes of text that an operator looks at at once.
SLICE = 6 << 20


def slices(batches, column: str, most: int = SLICE):
    """Arrow batches cut into parts of about ``most`` bytes in a column, so that what a
    task holds besides doesn't grow with the batch; a longer row is a part of its own.
    Memory goes back to the machine in the end, as Python workers live on."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
        if not batch.num_rows:
            yield batch
    pa.default_memory_pool().release_unused()
    _trim()


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc here
        pass
