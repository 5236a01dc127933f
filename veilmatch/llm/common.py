"""What the corpus operators share: Arrow helpers, the shared folder, worker imports.

Nothing here keeps rows on the driver.  Tables that cut lineage are written as
Parquet below ``spark.checkpoint.dir``, the one folder that the driver and all
executors see, so that a lost executor never loses them.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the contracts that say ``[^\x20\x09-\x0D]+``: exactly what bytes.split() takes.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and turns every byte outside ``[0-9a-z\x80-\xff]`` into a space.
ALNUM_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package also when it is not installed (local sessions started elsewhere)."""
    env = getattr(getattr(spark, "sparkContext", None), "environment", None)
    if env is not None and _HERE not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_HERE, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or setCheckpointDir() names; a temporary one only in local sessions that name none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = named.get() if named.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="veilmatch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/veilmatch/{tag}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan after it starts from files."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veil_path = path  # type: ignore[attr-defined]
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by write_table() once nothing reads it any more."""
    if path := getattr(df, "_veil_path", None):
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(df: DataFrame, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(modulus)


def packed(df: DataFrame) -> Column:
    """Whole rows in one column, ``_row``: no name in them can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def byte_rows(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row of a string or binary column; null is empty."""
    data, off = flat_bytes(col)
    mv = memoryview(data)
    o = off.tolist()
    return [bytes(mv[a:b]) for a, b in zip(o, o[1:])]


def flat_bytes(col: pa.Array) -> tuple[memoryview, np.ndarray]:
    """(all bytes, int64 offsets of the rows) of a string or binary column without copying rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, pa.scalar(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "", col.type))
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    return memoryview(buf) if buf is not None else memoryview(b""), off


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which other tasks use again, gives back the memory that it no longer needs."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return tidied


def spans(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows of at most ``most`` bytes together (a longer row stands alone)."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def int64(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest hash of ``key``.

    A threshold on the hash first leaves about ``1.2 n`` rows of the whole table, so
    that what reaches the driver does not grow with the number of tasks.
    """
    total = df.count()
    order = F.xxhash64(key)
    if total > 2 * n:
        df = df.where(F.shiftrightunsigned(order, 33) <= F.lit(int((1.2 * n + 100) / total * 2**31)))
    return df.orderBy(order, key).limit(n)
