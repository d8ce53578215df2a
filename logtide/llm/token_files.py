"""Token files: frequency-ranked ids in a byte-aligned variable-length code.

Documents are range-partitioned by id, encoded, and written in chunks of about
``CHUNK`` ids. A chunk is one self-contained binary record:

    magic ``LTK1`` | u32 documents | u32 distinct ids | u64 ids
    u32 id of each rank, most frequent first
    i64 doc_id of each document | u8 null flag of each | u32 id count of each
    control bytes: 2 bits an id, its rank's length in bytes less 1, four a byte
    data bytes: the ranks, little-endian, without leading zero bytes

Control and data bytes lie apart, so a decoder turns all control bytes into
lengths by one table lookup, and lengths into places by one prefix sum. Ranks
are the chunk's own: its commonest 256 ids take one byte, and no count of the
whole corpus has to precede the writing.

Spark's own writer commits the records, so files appear whole or not at all,
in any store Spark can write.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import BATCH, encoder, with_end

MAGIC = b"LTK1"
CHUNK = 1 << 20
_HEAD = struct.Struct("<4sIIQ")
#: Lengths of the four ids of a control byte.
_LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3) + 1


def pack_ids(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One chunk of documents, ``counts`` ids each."""
    freq = np.bincount(ids, minlength=1)
    used = np.flatnonzero(freq)
    table = used[np.argsort(-freq[used], kind="stable")]
    rank_of = np.zeros(len(freq), np.uint32)
    rank_of[table] = np.arange(len(table), dtype=np.uint32)
    ranks = rank_of[ids]
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    codes[: len(ids)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < lengths[:, None]]
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(
        [_HEAD.pack(MAGIC, len(doc_ids), len(table), len(ids)), table.astype("<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.array(counts, "<u4").tobytes(), control.tobytes(), data.tobytes()]
    )


def unpack_ids(chunk: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, id counts and all ids of a chunk."""
    magic, n_docs, n_ranks, n = _HEAD.unpack_from(chunk)
    if magic != MAGIC:
        raise ValueError("not a token chunk")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(chunk, kind, count, at)
        at += out.nbytes
        return out

    table, docs, null, counts, control = take("<u4", n_ranks), take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs), take("u1", -(-n // 4))
    data = np.concatenate([np.frombuffer(chunk, np.uint8, -1, at), np.zeros(3, np.uint8)])
    lengths = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    where = np.cumsum(lengths) - lengths
    ranks = np.zeros(n, np.uint32)
    for k in range(int(lengths.max(initial=0))):
        more = lengths > k
        ranks[more] |= data[where[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return [None if z else d for d, z in zip(docs.tolist(), null.tolist(), strict=True)], counts, table[ranks]


_RECORD = "part int, chunk int, before long, n_docs int, n_tokens long, payload binary"


def _emit_chunks(path: str, gap: str, end_id: int):
    def run(it):
        part, chunk, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []

        def flush():
            nonlocal docs, counts, held, chunk, before
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([before], pa.int64()), pa.array([len(docs)], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([pack_ids(docs, counts, ids)], pa.binary())],
                ["part", "chunk", "before", "n_docs", "n_tokens", "payload"],
            )
            before += len(ids)
            chunk += 1
            docs, counts, held = [], [], []
            return out

        tokens = encoder(path, gap)
        for batch in C.batches(it, ["doc_id", "text"], BATCH):
            ids, n = with_end(*tokens.flat(batch.column("text")), end_id)
            docs += batch.column("doc_id").to_pylist()
            counts += n.tolist()
            held.append(ids)
            if sum(map(len, held)) >= CHUNK:
                yield flush()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, gap: str = "space") -> None:
    """Encode every text and write its ids, ``end_id`` after each document, to the folder ``out``.

    Files come in ascending id order by their ``part`` and ``chunk``; null ids
    first, rows that repeat an id by their text. A null text is empty: its ids
    are ``end_id`` alone. An empty table gives a folder without chunks.
    """
    spark = docs.sparkSession
    C.session_batches(spark)
    rows = C.own(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ranged = rows.repartitionByRange(C.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(_emit_chunks(tokenizer, gap, end_id), _RECORD).write.option("compression", "none").parquet(out)


def _emit_documents(it):
    for batch in it:
        for base, chunk in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
            docs, counts, ids = unpack_ids(chunk.as_buffer().to_pybytes())
            offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            wide = ids.astype("<u4")
            blob = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(offsets * 4), pa.py_buffer(wide)])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(offsets[:-1] + base), pa.array(counts.astype(np.int64)), blob.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of token files.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian
    unsigned 32-bit integers. Only each part's total (a row a part) is summed
    over the whole; chunks know what precedes them in their part.
    """
    records = spark.read.schema(_RECORD).parquet(path)
    totals = records.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = records.join(F.broadcast(bases), "part")  # as many rows as the writer had partitions
    return placed.select((F.col("base") + F.col("before")).alias("start"), "payload").mapInArrow(_emit_documents, "doc_id long, start long, n_tokens long, ids binary")
