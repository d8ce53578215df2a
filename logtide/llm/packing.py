"""Packing documents into sequences by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens. The program
(``packing_lp``) sees only the histogram of piece lengths, which ``capacity``
bounds, and returns bins by content. Pieces then find their place by rank:
the k-th piece of a length takes the k-th opening for that length. Ranks come
from counts by task and length, so no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .packing_lp import configurations
from .tokens import BATCH, encoder, with_end

_PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def _emit_pieces(path: str, gap: str, end_id: int, capacity: int):
    def run(it):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tokens = encoder(path, gap)
        for batch in C.batches(it, ["doc_id", "text"], BATCH):
            ids, n = with_end(*tokens.flat(batch.column("text")), end_id)
            pieces = -(-n // capacity)
            rows = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * capacity
            length = np.minimum(n[rows] - start, capacity)
            wide, at = ids.astype("<u4"), (np.cumsum(n) - n)[rows] + start
            crc = [zlib.crc32(wide[i : i + k]) for i, k in zip(at.tolist(), length.tolist(), strict=True)]
            rank = np.zeros(len(rows), np.int64)
            for i, k in enumerate(length.tolist()):
                rank[i] = seen[k]
                seen[k] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(np.full(len(rows), part, np.int32)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return run


def openings(bins: list[tuple[list[int], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length: rows of (first rank, pieces a bin, first bin, offset in the bin), by rank."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    first_bin = 0
    for content, copies in bins:
        offset = 0
        for length, n in sorted(Counter(content).items(), reverse=True):
            out.setdefault(length, []).append((used[length], n, first_bin, offset))
            used[length] += n * copies
            offset += n * length
        if offset > capacity:
            raise ValueError("a bin is too full")
        first_bin += copies
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def _emit_places(places: dict[int, np.ndarray]):
    def run(it):
        for batch in it:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for s in np.unique(lengths).tolist():
                own, at = lengths == s, places[s]
                row = at[np.searchsorted(at[:, 0], ranks[own], "right") - 1]
                copy, slot = np.divmod(ranks[own] - row[:, 0], row[:, 1])
                sequence[own], offset[own] = row[:, 2] + copy, row[:, 3] + slot * s
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "piece", "start")), batch.column("length").cast(pa.int64()), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, gap: str = "white") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row for each piece.

    A document's tokens are its text's ids, then ``end_id``; only a document
    longer than ``capacity`` is cut. A null text is empty and makes a piece of
    one token. Each row is a document of its own, also where ids repeat or are
    null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    C.session_batches(spark)
    rows = C.own(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = C.materialize(rows.mapInArrow(_emit_pieces(tokenizer, gap, end_id, capacity), _PIECE), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r.length] = r.n
    places = openings(configurations(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part")
    bases = counts.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(_emit_places(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
