"""Substring dedup by Relative Lempel-Ziv parsing against indexed reference blocks.

A passage is a duplicate where ``length`` consecutive words of a document also
occur, in the same order, in a document with a smaller id. Documents are parsed
into factors: runs of word windows that a reference holds.

* **Routing.** Each window of ``length`` words is keyed by the least hash of
  its ``GRAM``-word grams (winnowing). Equal windows get equal keys, and about
  two windows in ``length - GRAM`` begin a new key, so a document becomes few
  *pieces*: runs of windows with one key. A reference block is what shares a
  key; only pieces that could match ever meet.
* **Blocks.** A block is read in document order. Its index maps windows to
  where they occur in the pieces of smaller documents. A piece is parsed
  greedily: look up the window at the cursor, extend the match along the
  reference as far as both agree, emit the factor, go on behind it. The window
  that straddles the factor's end is looked up by itself, so no match is lost
  at a factor boundary. What no reference holds joins the index.
* **Hot keys.** Pieces with equal content met earlier in the same task need no
  reference: the earlier document has them. (The task remembers a bounded
  number of pieces; forgetting one costs a row, not a result.) Pieces are
  counted by key over the whole input, and each key with ``HOT_PIECES`` or more
  is split by window, so a block of many different contexts round one common
  gram is spread over many tasks; a document's regular repeats of a window stay
  one row. Up to ``HOT_KEYS`` such keys go to every task, more are joined.

Windows are compared by a 48-bit hash within one 64-bit key, not word by word:
two different windows are taken for equal only where both agree, a chance of
about 2 ** -112 a pair (2 ** -33 that it happens at all among 10 ** 12 windows).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM = 16
#: A key with this many pieces, copies met in one task not counted, is split; keys up to which their list goes to every task (8 bytes each).
HOT_PIECES = 512
HOT_KEYS = 200_000
#: Pieces that a task remembers.
MEMORY = 1 << 20
_WIDTH = 6
_KNOWN = np.uint64((1 << 8 * _WIDTH) - 1)

_PIECE = "key long, doc_id long, at long, n int, step int, windows binary"
_FACTOR = "doc_id long, at long, n int, step int"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _pieces(batch: pa.RecordBatch, length: int):
    """Keys, row numbers, first windows, window counts and content hashes of a batch's pieces, with all window hashes."""
    data, offsets = C.text_buffer(batch.column("text"))
    starts, ends, first = C.word_bounds(data, offsets)
    n_words = np.diff(first)
    counts = np.where(batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False), np.maximum(n_words - length + 1, 0), 0)
    if not counts.sum():
        return None
    gram = min(GRAM, length)
    rolling = C.Rolling(C.word_hashes(data, starts, ends))
    at = np.arange(len(starts) - gram + 1)
    least = _sliding_min(rolling.of(at, at + gram), length - gram + 1)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    inner = np.arange(len(rows)) - begin[rows]  # window number in its document
    where = first[:-1][rows] + inner
    windows = rolling.of(where, where + length)
    keys = least[where]
    cut = np.ones(len(rows), bool)
    cut[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    lo = np.flatnonzero(cut)
    hi = np.append(lo[1:], len(rows))
    content = C.Rolling(windows).of(lo, hi) ^ keys[lo]
    return keys[lo], rows[lo], inner[lo], hi - lo, content, windows, lo


def _binary(windows: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.Array:
    """The chosen pieces' windows as ``_WIDTH`` bytes each."""
    offsets = np.zeros(len(lo) + 1, np.int64)
    np.cumsum(n, out=offsets[1:])
    take = np.repeat(lo - offsets[:-1], n) + np.arange(offsets[-1])
    raw = np.ascontiguousarray(windows[take].view(np.uint8).reshape(-1, 8)[:, :_WIDTH])
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer((offsets * _WIDTH).astype(np.int32)), pa.py_buffer(raw)])


def _progressions(key, doc, at, window, count, length: int):
    """Join a document's repeats of one window where they recur at equal distances of at most ``length``.

    A text that repeats a few words over and over has the same few windows all
    along; each of them becomes one row. Returns key, doc, at, window, windows
    held, repeats and distance.
    """
    order = np.lexsort((at, key, doc))
    key, doc, at, window, count = key[order], doc[order], at[order], window[order], count[order]
    n = len(key)
    gap = np.zeros(n, np.int64)
    alone = count > 1
    joined = np.zeros(n, bool)
    joined[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] >> 32 == at[:-1] >> 32) & ~alone[1:] & ~alone[:-1] & (at[1:] - at[:-1] > 1) & (at[1:] - at[:-1] <= length)
    gap[1:] = at[1:] - at[:-1]
    cut = ~joined
    cut[1:] |= joined[1:] & joined[:-1] & (gap[1:] != gap[:-1])
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, n))
    step = np.where(size > 1, gap[np.minimum(begin + 1, n - 1)], 1)
    return key[begin], doc[begin], at[begin], window[begin], count[begin], np.where(size > 1, size, count[begin]), step


def _split(k: np.ndarray, d: np.ndarray, a: np.ndarray, w: np.ndarray, c: np.ndarray, windows: np.ndarray, length: int):
    """Pieces as a row for each run of equal windows, with a key of its own; see ``_progressions``."""
    piece = np.repeat(np.arange(len(c)), c)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(c) - c, c)
    value = windows[w[piece] + inside] & _KNOWN
    begin = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (piece[1:] != piece[:-1])))
    c = np.diff(np.append(begin, len(piece)))
    inside, piece = inside[begin], piece[begin]
    return _progressions(C.mix(k[piece] ^ value[begin]), d[piece], a[piece] + inside, w[piece] + inside, c, length)


def _rows(k, d, a, w, c, times, step, windows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(d), pa.array(a), pa.array(times.astype(np.int32)), pa.array(step.astype(np.int32)), _binary(windows, w, c)], ["key", "doc_id", "at", "n", "step", "windows"])


def _emit_split(length: int):
    """Splits pieces that are marked hot; the others stay as they are."""

    def run(it):
        for batch in it:
            marked = batch.column("hot").fill_null(False).to_numpy(zero_copy_only=False) & batch.column("windows").is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~marked)).select(["key", "doc_id", "at", "n", "step", "windows"])
            if marked.any():
                part = batch.filter(pa.array(marked))
                raw = np.frombuffer(b"".join(part.column("windows").to_pylist()), np.uint8).reshape(-1, _WIDTH)
                windows = np.zeros((len(raw), 8), np.uint8)
                windows[:, :_WIDTH] = raw
                windows = windows.reshape(-1).view(np.uint64)
                k, d, a, c = (part.column(n).to_numpy() for n in ("key", "doc_id", "at", "n"))
                c = c.astype(np.int64)
                yield _rows(*_split(k.view(np.uint64), d, a, np.cumsum(c) - c, c, windows, length), windows)

    return run


def _emit_pieces(length: int, hot: np.ndarray):
    def run(it):
        seen: dict[int, int] = {}
        for batch in C.batches(it, ["doc_id", "text"]):
            found = _pieces(batch, length)
            if found is None:
                continue
            keys, rows, inner, n, content, windows, lo = found
            docs = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)[rows]
            texts = batch.column("text")
            used = np.unique(rows)
            crc = np.zeros(batch.num_rows, np.int64)
            crc[used] = [zlib.crc32(texts[int(r)].as_buffer()) for r in used]
            at = ((crc[rows] - (1 << 31)) << 32) | inner
            order = np.lexsort((docs, content))
            new = np.ones(len(order), bool)
            new[1:] = content[order][1:] != content[order][:-1]
            least = docs[order][new]  # smallest document by content
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            got = [seen.get(c) for c in content[order][new].tolist()]
            best = np.array([m if s is None or m < s else s for s, m in zip(got, least.tolist(), strict=True)], np.int64)
            known = docs > best[group]
            if len(seen) > MEMORY:
                seen.clear()
            seen.update(zip(content[order][new].tolist(), best.tolist(), strict=True))
            keep = np.flatnonzero(~known)
            split = np.isin(keys[keep], hot)
            for part, is_hot in ((keep[~split], False), (keep[split], True)):
                if not len(part):
                    continue
                k, d, a, c, w = keys[part], docs[part], at[part], n[part], lo[part]
                split_up = _split(k, d, a, w, c, windows, length) if is_hot else (k, d, a, w, c, c, np.ones(len(part), np.int64))
                yield _rows(*split_up, windows)
            sure = np.flatnonzero(known)
            if len(sure):
                spread = C.mix(docs[sure].astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(docs[sure]), pa.array(at[sure]), pa.array(n[sure].astype(np.int32)), pa.array(np.ones(len(sure), np.int32)), pa.nulls(len(sure), pa.binary())], ["key", "doc_id", "at", "n", "step", "windows"])

    return run


def _emit_counts(length: int):
    """Keys and their pieces; equal pieces met before in the task count once, as far as it remembers."""

    def run(it):
        seen: set[int] = set()
        for batch in C.batches(it, ["doc_id", "text"]):
            found = _pieces(batch, length)
            if found is None:
                continue
            content, first = np.unique(found[4], return_index=True)
            new = np.array([c not in seen for c in content.tolist()], bool)
            if len(seen) > MEMORY:
                seen.clear()
            seen.update(content[new].tolist())
            keys, counts = np.unique(found[0][first[new]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    return run


def _emit_factors(it):
    """Parses one block after the other; rows come by key, then document."""
    key_now = doc_now = None
    index: dict[bytes, tuple[bytes, int]] = {}
    literals: list[tuple[bytes, bytes, int]] = []
    for batch in it:
        keys = batch.column("key").to_numpy()
        docs = batch.column("doc_id").to_numpy()
        ats = batch.column("at").to_numpy()
        ns = batch.column("n").to_numpy()
        steps = batch.column("step").to_numpy()
        blobs = batch.column("windows")
        sure = blobs.is_null().to_numpy(zero_copy_only=False)
        out_doc, out_at, out_n, out_step = [docs[sure]], [ats[sure]], [ns[sure]], [steps[sure]]
        met = np.zeros(len(keys), bool)  # shares its key with a neighbour, as far as this batch tells
        if len(keys):
            same = keys[1:] == keys[:-1]
            met[1:] |= same
            met[:-1] |= same
            met[-1] = True
            met[0] |= key_now is not None and keys[0] == key_now
        docs_l, ats_l, ns_l, steps_l = [], [], [], []
        for r in np.flatnonzero(met & ~sure).tolist():
            key, doc, at, n = keys[r], int(docs[r]), int(ats[r]), int(ns[r])
            blob = blobs[r].as_py()
            if key != key_now:
                key_now, doc_now = key, doc
                index, literals = {}, []
            elif doc != doc_now:
                for window, source, i in literals:
                    index.setdefault(window, (source, i))
                literals, doc_now = [], doc
            if not index:
                literals += [(blob[i : i + _WIDTH], blob, i) for i in range(0, len(blob), _WIDTH)]
                continue
            i, end = 0, len(blob)
            while i < end:
                hit = index.get(blob[i : i + _WIDTH])
                if hit is None:
                    literals.append((blob[i : i + _WIDTH], blob, i))
                    i += _WIDTH
                    continue
                source, o = hit
                span = min(end - i, len(source) - o)
                if blob[i : i + span] != source[o : o + span]:
                    span = _WIDTH
                    while blob[i + span : i + span + _WIDTH] == source[o + span : o + span + _WIDTH]:
                        span += _WIDTH
                docs_l.append(doc)
                ats_l.append(at + i // _WIDTH)
                ns_l.append(span // _WIDTH if steps[r] == 1 else n)
                steps_l.append(int(steps[r]))
                i += span
        out_doc.append(np.array(docs_l, np.int64))
        out_at.append(np.array(ats_l, np.int64))
        out_n.append(np.array(ns_l, np.int32))
        out_step.append(np.array(steps_l, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_doc, out_at, out_n, out_step)], ["doc_id", "at", "n", "step"])


def _emit_kept(length: int):
    def run(it):
        for batch in C.batches(it, ["doc_id", "text", "factors"]):
            n_words, n_removed, kept, spans = [], [], [], []
            for text, factors in zip(batch.column("text"), batch.column("factors").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.split()
                own = []
                if factors:
                    crc = zlib.crc32(raw) - (1 << 31)
                    for f in sorted((f["at"] & 0xFFFFFFFF, (f["n"] - 1) * f["step"]) for f in factors if f["at"] >> 32 == crc):
                        lo, hi = f[0], f[0] + f[1] + length
                        if own and lo <= own[-1]["end"]:
                            own[-1]["end"] = max(own[-1]["end"], hi)
                        else:
                            own.append({"start": lo, "end": hi})
                n_words.append(len(words))
                n_removed.append(sum(s["end"] - s["start"] for s in own))
                for s in reversed(own):
                    del words[s["start"] : s["end"]]
                kept.append(b" ".join(words))
                spans.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "kept_text", "spans"],
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Remove every passage of ``length`` words or more that a smaller document has.

    Returns ``doc_id, n_words, n_removed, kept_text, spans`` (word ranges, end
    exclusive), one row for each input row. Windows are judged on the input.

    A null text has no words. A row with a null id keeps its text and is no
    reference. Rows that share an id are no reference for each other; a repeat
    within one document is kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    C.session_batches(spark)
    rows = C.own(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    counted = rows.mapInArrow(_emit_counts(length), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    hot = C.materialize(counted.where(F.col("n") >= HOT_PIECES).select("key"), "hot")
    if hot.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        keys = np.sort(hot.toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64))
        pieces = rows.mapInArrow(_emit_pieces(length, keys), _PIECE)
    else:
        pieces = rows.mapInArrow(_emit_pieces(length, np.zeros(0, np.uint64)), _PIECE).join(hot.withColumn("hot", F.lit(True)), "key", "left").mapInArrow(_emit_split(length), _PIECE)
    blocks = pieces.repartition(C.partitions(spark), "key").sortWithinPartitions("key", "doc_id", "at")
    factors = blocks.mapInArrow(_emit_factors, _FACTOR).groupBy("doc_id").agg(F.collect_set(F.struct("at", "n", "step")).alias("factors"))
    return rows.join(factors, "doc_id", "left").mapInArrow(_emit_kept(length), "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start: long, end: long>>")
