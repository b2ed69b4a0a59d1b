"""Shared helpers of the corpus operators: tables, the shared folder, words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.store import cut, removed, shared_dir, stored  # noqa: F401

#: Words are runs of bytes other than these six, which is what bytes.split() does.
WHITE = b" \t\n\x0b\x0c\r"
#: UTF-8 continuation bytes; the other bytes of a text count its code points.
CONTINUATION = bytes(range(0x80, 0xC0))
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input that a bucket of counts stands for, and how many buckets there are at least and at most.
BUCKET, FEWEST, MOST = 4 << 20, 64, 1 << 20


def buckets_for(df: DataFrame) -> int:
    """A power of two of buckets, in proportion to the size of df's files as Catalyst knows it; FEWEST where it doesn't."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = size // BUCKET if size < 1 << 60 else FEWEST
    return 1 << (min(max(wanted, FEWEST), MOST) - 1).bit_length()


def as_bytes(name: str = "text"):
    """The text as UTF-8 bytes, null as empty; Python then splits without decoding."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def chunks(batches: Iterable[pa.RecordBatch], rows: int = 512, room: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and about so many bytes, so that long texts stay bounded in memory."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > room:
                n = max(1, n // 2)
            yield batch.slice(at, n)
            at += n


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may be another
        ctypes.CDLL(None).malloc_trim(0)
