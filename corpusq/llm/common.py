"""Pieces shared by the operators: word kernels over Arrow buffers, checkpoints, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these; all are ASCII, so bytes and code points agree.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
SEP = np.zeros(256, dtype=bool)
SEP[list(SEPARATORS)] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once; bounds a worker's arrays whatever the batch holds.
SLICE_BYTES = 2 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = tempfile.mkdtemp(prefix="corpusq-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table; the files go when the table is no longer referenced."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: survives lost executors, prunes columns."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/corpusq-{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that reads them has itself been written."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage once a phase is written.

    Spark drops a finished query's broadcasts, checkpoints and shuffle files only when the driver's
    collector has met what names them. With room left in the heap that is late: a phase's broadcasts
    would stay on the driver, its heap grow, and its shuffle files stay on disk, until long after.
    """
    spark.sparkContext._jvm.System.gc()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by text bytes; a document is never cut, so one longer than the limit stands alone."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(pc.fill_null(batch.column(text), "")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (null: empty)."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    sep = SEP[buf]
    edge = np.empty(len(buf), bool)
    edge[0] = True
    edge[1:] = sep[:-1]
    first = offs[:-1]
    edge[first[first < len(buf)]] = True
    starts = np.flatnonzero(~sep & edge)
    edge[-1] = True
    edge[:-1] = sep[1:]
    last = offs[1:] - 1
    edge[last[last >= 0]] = True
    ends = np.flatnonzero(~sep & edge) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, all from one running sum."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(buf)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(buf) + 1)[starts])


def worker_cache() -> dict:
    """A cache that lives as long as the Python worker; functions pickled by value lose their globals."""
    import sys

    return sys.__dict__.setdefault("_corpusq_worker_cache", {})


#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 24 << 20


def broadcast_if_small(df: DataFrame, row_bytes: Column | int = 16, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its rows, of ``row_bytes`` each, come to ``most`` at most; beyond that a shuffle joins it."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= most else df
