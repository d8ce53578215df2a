"""Document fingerprints by Order MinHash.

A text's k-mers of code points are numbered by occurrence (the second "abcd" is
another element than the first), hashed, and dealt to ``SKETCHES`` sketches by
their hash. A sketch keeps its ``KEPT`` least hashes, puts them back into text
order and hashes that tuple. Two texts agree in a sketch if the same k-mers
were least *and* stand in the same order, so likeness falls with edit distance,
also where a set of k-mers would be unchanged (Marcais et al., 2019). Dealing
k-mers to sketches instead of hashing each k-mer once for every sketch (as in
one-permutation hashing) makes the cost linear in the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K = 6
SKETCHES = 64
KEPT = 2
_EMPTY = np.uint32(0)
_SEED = np.uint64(0xA0761D6478BD642F)


_PLACE_BITS = 24
_HASH_BITS = np.uint64(64 - _PLACE_BITS)


def _ordered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes' high bits in ascending order (ties by place) and each one's place before."""
    short = hashes >> np.uint64(_PLACE_BITS)
    if len(short) > 1 << _PLACE_BITS:
        order = np.argsort(short, kind="stable")
        return short[order], order
    both = np.sort(short << np.uint64(_PLACE_BITS) | np.arange(len(short), dtype=np.uint64))
    return both >> np.uint64(_PLACE_BITS), (both & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def signature(points: np.ndarray, k: int = K, sketches: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """``sketches`` 32-bit hashes of a text's code points; 0 where a sketch is empty."""
    out = np.zeros(sketches, np.uint32)
    n = len(points) - k + 1
    if len(points) == 0:
        return out
    if n < 1:
        k, n = len(points), 1
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(C.Rolling.BASE) + points[i : i + n].astype(np.uint64) + np.uint64(1)
    gram, where = _ordered(C.mix(grams))
    first = np.ones(n, bool)
    first[1:] = gram[1:] != gram[:-1]
    run = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    occurrence = (np.arange(n) - run).astype(np.uint64)
    hashes = C.mix(C.mix(gram ^ _SEED) + occurrence * np.uint64(0x9E3779B97F4A7C15))
    ranked, by_rank = _ordered(hashes)  # by sketch (the high bits), then hash
    where = where[by_rank]
    bits = np.uint64(sketches.bit_length() - 1)
    sketch = (ranked >> (_HASH_BITS - bits)).astype(np.int64)
    begin = np.searchsorted(sketch, np.arange(sketches + 1))
    size = np.minimum(np.diff(begin), kept)
    pick = begin[:-1, None] + np.arange(kept)[None, :]
    real = np.arange(kept)[None, :] < size[:, None]
    pick = np.minimum(pick, n - 1)
    spot = np.where(real, where[pick], n)
    value = np.where(real, ranked[pick], 0)
    text_order = np.argsort(spot, axis=1, kind="stable")
    value = np.take_along_axis(value, text_order, 1).astype(np.uint64)
    tuples = np.full(sketches, _SEED)
    for j in range(kept):
        tuples = C.mix(tuples ^ value[:, j]) + np.uint64(j + 1)
    return np.where(size > 0, (tuples >> np.uint64(32)).astype(np.uint32) | np.uint32(1), _EMPTY)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of sketches that agree, of those not empty in both; 1 for two empty texts."""
    used = (a != 0) | (b != 0)
    return float((a == b)[used].mean()) if used.any() else 1.0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _emit(k: int, sketches: int, kept: int):
    def run(it):
        cols: list[list] = [[] for _ in range(8)]
        size = 0

        def flush():
            nonlocal cols, size
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], _NAMES)
            cols, size = [[] for _ in range(8)], 0
            return out

        def finish(row, follower):
            doc, text, own = row
            half = len(text) // 2
            edited = text[: len(text) - half] + follower[1][:half]
            sig = signature(_points(edited), k, sketches, kept)
            for c, v in zip(cols, (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes().hex(), sig.tobytes().hex(), likeness(own, sig), likeness(own, follower[2])), strict=False):
                c.append(v)

        held = run_now = None
        for batch in C.batches(it, ["run", "own", "doc_id", "text"]):
            for run_id, own_row, doc, text in zip(*(batch.column(n).to_pylist() for n in ("run", "own", "doc_id", "text")), strict=True):
                text = text or ""
                row = (doc, text, signature(_points(text), k, sketches, kept))
                if held is not None and run_id == run_now:
                    finish(held, row)
                    size += 1
                held, run_now = (row if own_row else None), run_id
                if size >= 500:
                    yield flush()
        if cols[0]:
            yield flush()

    return run


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int = SKETCHES, kept: int = KEPT) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to that and to the next document.

    The next document is the one behind in descending id order (null ids last;
    rows that repeat an id by their text), the first one behind the last. The
    edited text has the last floor(n / 2) code points replaced by the next
    document's first as many, or all it has. Null texts are empty. A single
    row is its own next document; an empty table gives no rows.

    Ids are cut into runs at fixed bounds; a run's last row and its next
    document meet because the first row of each run also goes to the run
    before. Only those few rows travel twice. Run k is partition k, so runs
    never share a task; rows without an id are one run.
    """
    spark = docs.sparkSession
    C.session_batches(spark)
    rows = C.own(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = C.partitions(spark)
    bounds = np.array(sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))), np.int64)  # n numbers at most

    @F.arrow_udf("int")
    def run_of(ids: pa.Array) -> pa.Array:
        # runs in descending id order: 0 has the largest ids, the last one the nulls
        runs = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, runs).astype(np.int32))

    placed = rows.withColumn("run", run_of("doc_id"))
    heads = [(r.run, r.head) for r in placed.groupBy("run").agg(F.max("doc_id").alias("head")).orderBy("run").collect()]  # a row a run
    # the head of a run also closes the run before it; the first head of all closes the last run
    closing = [(run, head, heads[i - 1][0]) for i, (run, head) in enumerate(heads)]
    closers = F.broadcast(spark.createDataFrame(closing, "run int, head long, before int"))
    marked = placed.join(closers, "run").select("doc_id", "text", "run", F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.col("before")).alias("before"))
    ways = F.array(F.struct("run", F.lit(True).alias("own")), F.struct(F.col("before").alias("run"), F.lit(False).alias("own")))
    both = marked.select(F.explode(F.filter(ways, lambda w: w["run"].isNotNull())).alias("way"), "doc_id", "text")
    dealt = both.select("way.run", "way.own", "doc_id", "text").repartitionById(n + 1, F.col("run")).sortWithinPartitions("run", F.desc("own"), F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(_emit(k, sketches, kept), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
