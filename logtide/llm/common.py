"""Input, shared-folder tables and word splitting used by the operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything between ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_written: list[tuple[SparkSession, str]] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (tests), a temporary
    folder is set for the session and used; on a cluster that is an error, as
    executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="logtide-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation, and
    several consumers see one set of rows. ``discard``, ``release`` or the end
    of the driver deletes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written(spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a table of ``materialize`` that nothing will read again."""
    _delete(df.sparkSession, df._written_to)
    _written.remove((df.sparkSession, df._written_to))


def written(spark: SparkSession, path: str) -> None:
    """Have ``release`` delete what was written to ``path``."""
    _written.append((spark, path))


def release() -> None:
    """Delete what ``materialize`` has written so far."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may be gone already
        _written.clear()


atexit.register(_at_exit)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator works on, under its own names.

    A table may have further columns, with any names; they never meet the
    operator's. ``columns`` maps the operator's name to the table's.
    """
    return df.select(*(F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets into them; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every text, and each text's first word number (n + 1 numbers)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] & inside[:-1]  # an inner joint of one word
    edge[offsets] = False  # texts don't run into each other
    starts = np.flatnonzero(inside & ~edge[:-1])
    ends = np.flatnonzero(inside & ~edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), bijective."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of slices, by prefix sums."""

    BASE = 0x9E3779B97F4A7C15
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        if len(Rolling._powers) < n:
            size = -(-n // (1 << 18)) << 18
            for name, base in (("_powers", self.BASE), ("_inverse", pow(self.BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(factors))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * Rolling._powers[: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * Rolling._inverse[starts])


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, about ``block`` bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, base + block)))
        out[i:j] = Rolling(_BYTE[data[base : ends[j - 1]]]).of(starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def give_back() -> None:
    """Return memory that is free by now to the system.

    Else a worker, which outlives its task, keeps the most that it ever held,
    and an executor has a few workers.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def batches(it, names: list[str], target: int = 1 << 20):
    """Record batches cut so that the text of one stays near ``target`` bytes."""
    for batch in it:
        size = batch.nbytes
        step = max(1, min(batch.num_rows, int(batch.num_rows * target / max(size, 1))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step).select(names)
        del batch
        give_back()


def slices(column: pa.Array, target: int = 1 << 18) -> list[pa.Array]:
    """A text column cut so that the text of one part stays near ``target`` bytes; one part at least.

    Array operations hold many bytes for each byte of a part, so parts are small.
    """
    give_back()  # of the column before
    step = max(1, min(len(column), int(len(column) * target / max(column.nbytes, 1))))
    return [column.slice(i, step) for i in range(0, max(len(column), 1), step)]


def cells(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin and end."""
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return begin, np.append(begin[1:], len(keys))


def whole_cells(it, decide, rows: int = 1 << 16):
    """Calls ``decide`` with the columns of whole cells, about ``rows`` at a time; rows come sorted by their first column, the cell."""
    held: list[list[np.ndarray]] = []
    waiting = 0
    for batch in it:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        waiting += batch.num_rows
        if waiting < rows or held[0][0][0] == held[-1][0][-1]:
            continue
        now = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = int(np.searchsorted(now[0], now[0][-1]))  # where the last cell, perhaps not whole yet, begins
        yield from decide(*(x[:last] for x in now))
        held = [[x[last:].copy() for x in now]]  # not a view, which would hold all of ``now``
        del now
        waiting = len(held[0][0])
        give_back()
    if held:
        yield from decide(*(np.concatenate(x) for x in zip(*held, strict=True)))
    del held
    give_back()


def session_batches(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and bytes, so that long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
