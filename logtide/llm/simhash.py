"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint holds, for each of 64 bits, the majority vote of its
shingles' hashes. Two fingerprints that differ in at most ``MAX_BITS`` = 3 bits
differ in at most one bit of their first or of their second half. So each half
is looked up in a table of that half, with the whole Hamming ball of radius 1:
the half itself, and the half with one set bit cleared (of two halves one bit
apart, exactly one has the bit set, so each pair meets once). Every match is
verified over all 64 bits.

Texts with equal fingerprints are one class throughout. A table cell hands on
the links of a spanning forest of what it verified, never all its pairs, so a
cell of n fingerprints makes less than n rows.

``similar_rows`` groups texts by the likeness of their shingle sets. Fingerprints
find the bulk of each group: what the tables link, and what shares a least hash
of its set with, and has a fingerprint near, one of two leaders. These links, a
few a text, are checked by exact Jaccard likeness. What is further apart is
found by shared rare shingles (``shingles``), between different groups only. So
no link is lost, and no group is compared pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import shingles as S
from .components import Forest, connected_components

BITS = 64
MAX_BITS = 3
#: Orders in which sets have a least hash, and bits that fingerprints of near copies rarely exceed. Both bear on speed only.
ORDERS = 8
NEAR_BITS = 16
#: Distances computed at once.
_BLOCK = 1 << 20
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles; 0 where it has no words."""
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], "<u8")
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _emit_fingerprints(shingle: int, seed: int):
    def run(it):
        for batch in C.batches(it, ["doc_id", "text"]):
            prints = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle, seed) if t.is_valid else 0 for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long), a row for each row; null texts are empty."""
    C.session_batches(docs.sparkSession)
    rows = C.own(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_emit_fingerprints(shingle, seed), "doc_id long, fp long")


def _close(a: np.ndarray, b: np.ndarray):
    """Pairs (i, j) with a[i] and b[j] at most MAX_BITS apart, a block of rows at a time."""
    step = max(1, _BLOCK // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= MAX_BITS)
        yield x + i, y


def _emit_links(it):
    """Cells hold first the table's rows (ball = 0), then the lookups (ball = 1)."""

    def decide(keys, ball, fps):
        fps = fps.view(np.uint64)
        cut, end = C.cells(keys)
        tables = np.add.reduceat(ball == 0, cut)
        worth = np.flatnonzero((tables >= 1) & (end - cut >= 2))
        us, vs = [], []
        for c in worth.tolist():
            part, n = fps[cut[c] : end[c]], int(tables[c])
            forest = Forest(len(part))
            for x, y in _close(part, part[:n]):
                other = part[x] != part[y]
                if other.any():
                    forest.link(x[other], y[other])
            roots = forest.roots()
            moved = np.flatnonzero(roots != np.arange(len(part)))
            if len(moved):
                us.append(part[moved])
                vs.append(part[roots[moved]])
        none = np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x]).view(np.int64)) for x in (us, vs)], ["u", "v"])

    yield from C.whole_cells(it, decide)


def near_links(classes: DataFrame) -> DataFrame:
    """``u, v``: links that span every component of the distinct ``fp`` at most MAX_BITS apart."""
    half = lambda k: F.expr(f"shiftrightunsigned(fp, {32 * k}) & 4294967295L")
    ball = "filter(transform(sequence(0, 31), b -> key & ~shiftleft(1L, b)), k -> k <> key)"
    table = classes.select(F.explode(F.array(*(F.struct(F.lit(k).alias("seg"), half(k).alias("key")) for k in (0, 1)))).alias("c"), "fp").select("c.seg", "c.key", "fp")
    cells = table.select("seg", F.explode(F.expr(f"concat(array(struct(key as key, 0 as ball)), transform({ball}, k -> struct(k as key, 1 as ball)))")).alias("c"), "fp")
    cells = cells.select((F.col("c.key") * 2 + F.col("seg")).alias("key"), F.col("c.ball").alias("ball"), "fp")
    dealt = cells.repartition(C.partitions(classes.sparkSession), "key").sortWithinPartitions("key", "ball", "fp")
    return dealt.mapInArrow(_emit_links, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Near-duplicate groups: ``doc_id, fp, component_id, is_first``, a row for each row.

    ``component_id`` is the smallest id reachable over links of fingerprints at
    most 3 bits apart; ``is_first`` marks one row of each group that has it (of
    rows that repeat an id, all with that id). Texts without words, nulls among
    them, share fingerprint 0 and so one group. Null ids take part; they are no
    group's smallest unless it has no other, and then ``is_first`` is true for
    that group's rows. An empty table gives no rows.
    """
    prints = C.materialize(fingerprints(docs, id_col, text_col, shingle, seed), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    parts = connected_components(near_links(classes.select("fp")))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = C.materialize(named.join(least, "component").select("fp", "component_id"), "labels")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("is_first"))


def _sketches(texts: pa.Array, shingle: int) -> pa.Array:
    """Each text's set of shingles as one hash, the set's size and least hashes, and its fingerprint."""
    hashes, offsets = S.shingle_sets(texts, shingle)
    n = np.diff(offsets)
    fp = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, offsets[:-1][full], axis=0, dtype=np.int32)
        fp[full] = np.packbits(ones * 2 > n[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    mins = S.least_hashes(hashes, offsets, ORDERS)
    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * ORDERS), pa.array(mins.reshape(-1).view(np.int64)))
    return pa.StructArray.from_arrays([pa.array(S.nodes(hashes, offsets).view(np.int64)), pa.array(fp.view(np.int64)), pa.array(n.astype(np.int64)), listed], ["node", "fp", "n", "mins"])


def _sketch(text: Column, shingle: int) -> Column:
    @F.arrow_udf("struct<node: long, fp: long, n: long, mins: array<long>>")
    def sketch(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_sketches(part, shingle) for part in C.slices(texts)])

    return sketch.asNondeterministic()(text)  # said to vary, so that Spark computes it once a row and not again below joins


def _moved(text: Column, shingle: int, bits: np.ndarray) -> Column:
    """A text's node, and whether the filter may hold it."""

    @F.arrow_udf("struct<node: long, moved: boolean>")
    def told(texts: pa.Array) -> pa.Array:
        node = np.concatenate([S.nodes(*S.shingle_sets(part, shingle)) for part in C.slices(texts)]).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(node), pa.array(S.may_hold(bits, node))], ["node", "moved"])

    return told.asNondeterministic()(text)


def _emit_leaders(least: float):
    """Links of a cell's nodes to two of them, the same for all, where size and fingerprint allow likeness."""

    def decide(keys, node, fp, n):
        fp = fp.view(np.uint64)
        order = np.lexsort((C.mix(node.view(np.uint64) ^ keys.view(np.uint64)), keys))
        node, fp, n = node[order], fp[order], n[order]
        cut, end = C.cells(keys)
        for k in (0, 1):
            lead = np.repeat(np.minimum(cut + k, end - 1), end - cut)
            near = (node != node[lead]) & (np.bitwise_count(fp ^ fp[lead]) <= NEAR_BITS) & (np.minimum(n, n[lead]) >= least * np.maximum(n, n[lead]) - 1e-9)
            u, v = node[near], node[lead[near]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return lambda it: C.whole_cells(it, decide)


def similar_links(classes: DataFrame, texts: DataFrame, shingle: int = S.SHINGLE, least: float = S.LEAST) -> DataFrame:
    """``u, v``: links that span the groups of ``classes(node, fp, n, mins)`` by likeness; ``texts(text)`` has their texts."""
    # what fingerprints reach: a few comparisons for each node, not for each pair
    spans = near_links(classes.select("fp").distinct()).distinct()
    heads = classes.groupBy("fp").agg(F.min("node").alias("head"))
    side = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    apart = spans.join(side("u"), "u").join(side("v"), "v").select(F.least("head_u", "head_v").alias("u"), F.greatest("head_u", "head_v").alias("v"))
    twins = classes.join(heads, "fp").where("node <> head").select(F.least("node", "head").alias("u"), F.greatest("node", "head").alias("v"))
    dealt = classes.where("n > 0").select(F.explode("mins").alias("key"), "node", "fp", "n").repartition(C.partitions(classes.sparkSession), "key").sortWithinPartitions("key")
    led = dealt.mapInArrow(_emit_leaders(least), "u long, v long")
    links = C.materialize(S.verified(C.materialize(apart.union(twins).union(led).distinct(), "candidates"), texts, shingle, least), "similar")
    # the rest: only pairs of different groups are still open
    groups = connected_components(links).select("node", F.col("component").alias("group"))
    return links.union(S.prefix_links(texts, groups, shingle, least))


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = S.SHINGLE, least: float = S.LEAST) -> DataFrame:
    """One row of each group of near copies, with all its columns; the others go.

    Texts are linked where their sets of ``shingle`` words (A-Z as a-z) have a
    Jaccard likeness of ``least`` or more; groups are what links reach. Of a
    group stays the row with the smallest id (nulls last; of equal ids the same
    text each time). Texts with equal sets are of one group, so null texts and
    texts without words are one. Every row is a row of its own, whatever ids
    repeat. Columns may have any names. An empty table gives no rows.
    """
    C.session_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketched = rows.withColumn("sketch", _sketch(F.col("text"), shingle))
    first = F.struct(F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0)).alias("id"))
    classes = C.materialize(sketched.select("id", "sketch.*").groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("mins").alias("mins"), F.min(first).alias("first"), F.count("*").alias("rows")), "classes")
    links = similar_links(classes.select("node", "fp", "n", "mins"), rows.select("text"), shingle, least)
    named = classes.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = C.materialize(named.select("node", "rows", "component", "first"), "named")
    winners = named.groupBy("component").agg(F.min(F.struct("first.unnamed", "first.id", "node")).alias("least")).select(F.col("least.node").alias("node"))
    # a node of one row that wins keeps its row where it is; only rows of other nodes, and what their filter can't tell from them, travel
    winners = C.materialize(winners, "winners")
    moved = S.node_filter(named.join(winners, "node", "left_anti").select("node").union(named.where("rows > 1").select("node")))
    told = rows.withColumn("told", _moved(F.col("text"), shingle, moved))
    order = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last(), "text")
    ranked = told.where("told.moved").select("row", "id", "text", "told.node").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return told.where("not told.moved").select("row.*").union(ranked.join(winners, "node", "left_semi").select("row.*"))
