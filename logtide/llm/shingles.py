"""Sets of word shingles, their exact Jaccard likeness, and pairs that may reach it.

Prefix filter: with all shingles in one fixed order, two sets of likeness
``least`` or more share one of their first ``n - ceil(least * n) + 1`` shingles.
So each text is dealt to the cells of that prefix, and what meets in a cell and
is not ruled out by sizes and places is a candidate. No pair is lost, whatever
the order: it only puts shingles that a sample of texts shares last, so that
cells stay small.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import Forest

#: Bits of a filter of nodes (4 MB), whatever the input. What passes it wrongly is joined in vain.
FILTER_BITS = 1 << 25
SHINGLE = 5
LEAST = 0.8
#: Texts looked at for common shingles, and most common shingles known. Both bear on speed only.
SAMPLE = 20_000
COMMON = 100_000
#: Rows up to which a cell is small, and pairs looked at once in a larger one.
_LARGE = 24
_BLOCK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text and their n + 1 offsets.

    A-Z counts as a-z. Fewer words than a shingle are one; no words, none.
    """
    data, offsets = C.text_buffer(texts)
    data = _LOWER[data]
    starts, ends, first = C.word_bounds(data, offsets)
    words = np.diff(first)
    rolling = C.Rolling(C.word_hashes(data, starts, ends))
    row = np.repeat(np.arange(len(words)), words)
    at = np.arange(len(row))
    full = at + shingle <= first[1:][row]
    short = (words > 0) & (words < shingle)
    hashes = rolling.of(np.concatenate([at[full], first[:-1][short]]), np.concatenate([at[full] + shingle, first[1:][short]]))
    rows = np.concatenate([row[full], np.flatnonzero(short)])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.append(0, np.cumsum(np.bincount(rows[new], minlength=len(words))))


def nodes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    return C.Rolling(hashes).of(offsets[:-1], offsets[1:])


def least_hashes(hashes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The least of each set's hashes in ``n`` orders (rows: sets); 0 for the empty set."""
    out = np.zeros((len(offsets) - 1, n), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    for k in range(n if len(full) else 0):
        out[full, k] = np.minimum.reduceat(C.mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)), offsets[:-1][full])
    return out


def alike(a: pa.Array, b: pa.Array, shingle: int = SHINGLE, least: float = LEAST) -> np.ndarray:
    """Whether the sets of two texts have a Jaccard likeness of ``least`` or more, row by row."""
    (p, p_at), (q, q_at) = shingle_sets(a, shingle), shingle_sets(b, shingle)
    n = len(a)
    rows = np.concatenate([np.repeat(np.arange(n), np.diff(p_at)), np.repeat(np.arange(n), np.diff(q_at))])
    both = np.concatenate([p, q])
    order = np.lexsort((both, rows))
    both, rows = both[order], rows[order]
    twin = (both[1:] == both[:-1]) & (rows[1:] == rows[:-1])
    common = np.bincount(rows[1:][twin], minlength=n)
    return common >= least * (np.diff(p_at) + np.diff(q_at) - common) - 1e-9


def near(a: str, b: str, shingle: int = SHINGLE, least: float = LEAST) -> Column:
    """``alike`` of two text columns."""

    @F.arrow_udf("boolean")
    def check(x: pa.Array, y: pa.Array) -> pa.Array:
        C.give_back()
        step = max(1, min(len(x), int(len(x) * (1 << 18) / max(x.nbytes + y.nbytes, 1))))
        return pa.array(np.concatenate([alike(x.slice(i, step), y.slice(i, step), shingle, least) for i in range(0, max(len(x), 1), step)]))

    return check(F.col(a), F.col(b))


def node_filter(members: DataFrame) -> np.ndarray:
    """A Bloom filter of ``members(node)`` as bytes: two bits a node, ``FILTER_BITS`` in all.

    Built by the executors; the driver gets the finished bits, no more for more members.
    """
    spots = members.select(F.explode(F.array(*(F.expr(f"shiftrightunsigned(node, {k}) & {FILTER_BITS - 1}L") for k in (0, 32)))).alias("p"))
    blocks = spots.groupBy(F.expr("p div 32768").alias("block")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("bits"))
    out = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for r in blocks.collect():  # FILTER_BITS / 32768 rows at most
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def may_hold(bits: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Whether each node may be a member; never false for one that is."""
    spots = [(node.view(np.uint64) >> np.uint64(k)) & np.uint64(FILTER_BITS - 1) for k in (0, 32)]
    first, second = ((bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in spots)
    return (first & second).astype(bool)


def _emit_members(shingle: int, bits: np.ndarray):
    def run(it):
        for batch in C.batches(it, ["text"], 1 << 18):
            node = nodes(*shingle_sets(batch.column("text"), shingle)).view(np.int64)
            keep = pa.array(may_hold(bits, node))
            yield pa.RecordBatch.from_arrays([pa.array(node), batch.column("text")], ["node", "text"]).filter(keep)

    return run


def texts_of(members: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``node, text``: one text of each of ``members(node)``. Texts that the members' filter rules out don't travel."""
    found = texts.mapInArrow(_emit_members(shingle, node_filter(members)), "node long, text string")
    return found.join(members, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Those ``pairs(u, v)`` of nodes whose texts have a likeness of ``least`` or more. Only their texts travel."""
    members = C.materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    held = C.materialize(texts_of(members, texts, shingle), "members")
    sided = pairs.join(held.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return sided.where(near("a", "b", shingle, least)).select("u", "v")


def _emit_shingles(shingle: int):
    def run(it):
        for batch in C.batches(it, ["text"], 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column("text"), shingle)[0].view(np.int64))], ["h"])

    return run


def _emit_prefixes(shingle: int, least: float, common: np.ndarray, level: np.ndarray):
    def run(it):
        for batch in C.batches(it, ["text"], 1 << 18):
            hashes, offsets = shingle_sets(batch.column("text"), shingle)
            node, n = nodes(hashes, offsets), np.diff(offsets)
            once = np.zeros(len(node), bool)
            once[np.unique(node, return_index=True)[1]] = True
            row = np.repeat(np.arange(len(n)), n)
            spot = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
            rank = np.where(common[spot] == hashes, level[spot], 0) if len(common) else np.zeros(len(hashes), np.int64)
            order = np.lexsort((hashes, rank, row))
            place = np.arange(len(row)) - offsets[:-1][row]
            take = (place < (n - np.ceil(least * n - 1e-9).astype(np.int64) + 1)[row]) & once[row]
            row, place, key = row[take], place[take], hashes[order][take]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[row].view(np.int64)), pa.array(n[row].astype(np.int32)), pa.array(place.astype(np.int32))], ["key", "node", "n", "place"])

    return run


def _emit_candidates(least: float):
    """Cells: pairs of nodes of different groups that can still be alike; of a large cell its rows instead (key, node)."""

    def open_(s, p, g, t, q, h):
        """Sizes and places leave room for ``least``, and the groups differ."""
        return (g != h) & (1 + np.minimum(s - p, t - q) - 1 >= least / (1 + least) * (s + t) - 1e-6)

    def told(x, y, wide=False):
        return pa.RecordBatch.from_arrays([pa.array(x if wide else np.minimum(x, y)), pa.array(y if wide else np.maximum(x, y)), pa.array(np.full(len(x), wide))], ["u", "v", "wide"])

    def decide(keys, node, n, place, group):
        cut, end = C.cells(keys)
        size = end - cut
        mixed = np.minimum.reduceat(group, cut) != np.maximum.reduceat(group, cut)
        n, place = n.astype(np.int64), place.astype(np.int64)
        for k in range(2, _LARGE + 1):  # all cells of one size at once
            at = cut[mixed & (size == k)]
            for i in range(k if len(at) else 0):
                for j in range(i + 1, k):
                    a, b = at + i, at + j
                    near = open_(n[a], place[a], group[a], n[b], place[b], group[b])
                    if near.any():
                        yield told(node[a[near]], node[b[near]])
        wide = mixed & (size > _LARGE)
        rows, named = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)  # of large cells, only what some other row leaves open
        for lo, hi in zip(cut[wide].tolist(), end[wide].tolist(), strict=True):
            step = max(1, _BLOCK // (hi - lo))
            for i in range(lo, hi, step):
                a, b = (slice(i, min(i + step, hi)), None), (None, slice(lo, hi))
                near = open_(n[a], place[a], group[a], n[b], place[b], group[b])
                rows[a[0]] |= near.any(1)
            left = node[lo:hi][rows[lo:hi]]
            named[lo:hi] = C.mix(left.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)  # cells of the same nodes become one
        if rows.any():
            yield told(named[rows], node[rows], True)

    return lambda it: C.whole_cells(it, decide)


def _by_cell(decide):
    """Calls ``decide`` with each cell's rows as a table; rows come sorted by ``key``."""

    def run(it):
        held = None
        for batch in it:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            keys = held.column("key").to_numpy()
            if keys[0] != keys[-1]:
                cut, end = C.cells(keys)
                for lo, hi in zip(cut[:-1].tolist(), end[:-1].tolist(), strict=True):
                    yield decide(held.slice(lo, hi - lo))
                held = held.slice(int(cut[-1]))
        if held is not None:
            yield decide(held)
        del held
        C.give_back()

    return run


def _emit_alike(least: float):
    """Links of a cell's sets, a spanning forest of them; what a group links already is not compared.

    Shingles are counted by their first byte; the sum of the lesser counts is
    never less than what two sets share, so most pairs fall by it. The others
    are compared shingle by shingle.
    """

    def decide(t: pa.Table):
        node, group = t.column("node").to_numpy(), t.column("group").to_numpy()
        sets = t.column("hashes").combine_chunks()
        at, flat = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
        n = np.diff(at)
        rows = np.repeat(np.arange(len(n)), n)
        counts = np.bincount(rows * 256 + (flat[at[0] : at[-1]] >> np.uint64(56)).astype(np.int64), minlength=len(n) * 256).reshape(-1, 256)
        counts = counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32)
        forest = Forest(len(n))
        first = np.unique(group, return_index=True, return_inverse=True)
        forest.link(np.arange(len(n)), first[1][first[2]])
        us, vs = [], []
        for i in range(len(n) - 1):
            roots = forest.roots()
            near = i + 1 + np.flatnonzero((roots[i + 1 :] != roots[i]) & (np.minimum(n[i], n[i + 1 :]) >= least * np.maximum(n[i], n[i + 1 :]) - 1e-9))
            must = least / (1 + least) * (n[i] + n[near]) - 1e-6
            near, must = (x[np.minimum(counts[i], counts[near]).sum(1, dtype=np.int64) >= must] for x in (near, must))
            for j, need in zip(near.tolist(), must.tolist(), strict=True):
                if forest.roots()[i] != forest.roots()[j] and len(np.intersect1d(flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]], assume_unique=True)) >= need:
                    forest.link(np.array([i]), np.array([j]))
                    us.append(min(node[i], node[j]))
                    vs.append(max(node[i], node[j]))
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return _by_cell(decide)


def _fold(counts: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Counts of ``rows`` (each of ``size`` bins or twice as many) in ``size`` bins."""
    out = np.zeros((len(rows), size), np.uint16)
    for double in (False, True):
        own = np.flatnonzero(sizes[rows] == size * (1 + double))
        at = offsets[rows[own]][:, None] + np.arange(size * (1 + double))
        found = counts[at].astype(np.uint16)
        out[own] = found.reshape(len(own), size, 2).sum(2, dtype=np.uint16) if double else found
    return out


def bin_counts(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles of each set begin with each bit string, in about a bin for four shingles (a power of two, 16 at least), and the n + 1 offsets.

    The sum of the lesser counts of two sets is never less than what they share.
    A count stays far below 256, as hashes spread.
    """
    n = np.diff(offsets)
    level = np.maximum(4, np.ceil(np.log2(np.maximum(n, 1) / 4))).astype(np.int64)
    ends = np.append(0, np.cumsum(1 << level))
    row = np.repeat(np.arange(len(n)), n)
    spots = ends[:-1][row] + (hashes >> (64 - level[row]).astype(np.uint64)).astype(np.int64)
    return np.minimum(np.bincount(spots, minlength=ends[-1]), 255).astype(np.uint8), ends


def _emit_counts(shingle: int, bits: np.ndarray):
    def run(it):
        for batch in C.batches(it, ["text"], 1 << 18):
            hashes, offsets = shingle_sets(batch.column("text"), shingle)
            node = nodes(hashes, offsets).view(np.int64)
            counts, ends = bin_counts(hashes, offsets)
            binary = pa.Array.from_buffers(pa.large_binary(), len(node), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(counts)]).cast(pa.binary())
            keep = pa.array(may_hold(bits, node))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.diff(offsets).astype(np.int32)), binary], ["node", "n", "counts"]).filter(keep)

    return run


def _emit_open(least: float):
    """Rows of a cell (key, node) whose sizes and counts leave room for ``least`` with some row of another group."""

    def decide(t: pa.Table):
        order = np.argsort(-t.column("n").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        group, n = t.column("group").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        binary = t.column("counts").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(n) + 1]
        counts, sizes = np.frombuffer(binary.buffers()[2], np.uint8), np.diff(offsets)
        upto = np.searchsorted(-n, -(least * n - 1e-9), "right")  # of the rows behind, those large enough
        rows = np.zeros(len(n), bool)
        for size in np.unique(sizes).tolist():
            # sizes fall along the rows, so those of equal bins are neighbours; a row meets its own bins and the next lesser ones
            lo, hi = np.flatnonzero(sizes == size)[[0, -1]] + (0, 1)
            ahead = lo - int((sizes[:lo] == 2 * size).sum())
            folded = _fold(counts, offsets[:-1], sizes, np.arange(ahead, hi), size)
            for i in range(ahead, hi):
                near = np.arange(max(i + 1, lo), min(int(upto[i]), hi))
                near = near[(group[near] != group[i]) & ~(rows[near] & rows[i])]
                must = least / (1 + least) * (n[i] + n[near]) - 1e-6
                step = max(1, _BLOCK // size)
                for k in range(0, len(near), step):
                    part = near[k : k + step]
                    open_ = part[np.minimum(folded[i - ahead], folded[part - ahead]).sum(1, dtype=np.int64) >= must[k : k + step]]
                    rows[open_] = True
                    rows[i] |= len(open_) > 0
        return pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), t.column("node").combine_chunks()], ["key", "node"]).filter(pa.array(rows))

    return _by_cell(decide)


def _emit_sets(shingle: int, bits: np.ndarray):
    def run(it):
        for batch in C.batches(it, ["text"], 1 << 18):
            hashes, offsets = shingle_sets(batch.column("text"), shingle)
            node = nodes(hashes, offsets).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node), listed], ["node", "hashes"]).filter(pa.array(may_hold(bits, node)))

    return run


def prefix_links(texts: DataFrame, groups: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``u, v``: links of a likeness of ``least`` or more that join what ``groups(node, group)`` leaves apart."""
    spark = texts.sparkSession
    parts = max(1, math.ceil(texts.count() / SAMPLE))
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).distinct()
    shared = drawn.mapInArrow(_emit_shingles(shingle), "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "h").limit(COMMON).toPandas()
    common, level = shared["h"].to_numpy(np.int64).view(np.uint64), shared["c"].to_numpy(np.int64)
    order = np.argsort(common)
    prefixes = texts.mapInArrow(_emit_prefixes(shingle, least, common[order], level[order]), "key long, node long, n int, place int")
    grouped = prefixes.join(groups, "node", "left").select("key", "node", "n", "place", F.coalesce("group", "node").alias("group"))
    dealt = grouped.repartition(C.partitions(spark), "key").sortWithinPartitions("key")
    found = C.materialize(dealt.mapInArrow(_emit_candidates(least), "u long, v long, wide boolean").distinct(), "candidates")
    # pairs of small cells are checked one by one; large cells by counts, and what these leave open as a whole, by sets
    wide = found.where("wide").select(F.col("u").alias("key"), F.col("v").alias("node"))

    def in_cells(rows: DataFrame, emit, schema: str, column: str) -> DataFrame:
        members = C.materialize(rows.select("node").distinct(), "nodes")
        held = texts.mapInArrow(emit(shingle, node_filter(members)), schema).join(members, "node", "left_semi").groupBy("node").agg(*(F.min(c).alias(c) for c in column.split()))
        joined = rows.join(held, "node").join(groups, "node", "left").select("key", "node", F.coalesce("group", "node").alias("group"), *column.split())
        return joined.repartition(C.partitions(spark), "key").sortWithinPartitions("key", "node")

    left = C.materialize(in_cells(wide, _emit_counts, "node long, n int, counts binary", "n counts").mapInArrow(_emit_open(least), "key long, node long"), "open")
    alike_ = in_cells(left, _emit_sets, "node long, hashes array<long>", "hashes").mapInArrow(_emit_alike(least), "u long, v long")
    return verified(found.where("not wide").select("u", "v"), texts, shingle, least).union(alike_)
