"""Embedding near-dedup: an exact metric range join over pivot cells.

Unit vectors with cosine >= t are at most r = sqrt(2 - 2 t) apart. Pivots, few
vectors far from each other, part the vectors of each label into cells (nearest
pivot). A vector y within r of x, whose home pivot is p, obeys by the triangle
inequality d(y, p) <= d(y, q) + 2 r for y's own nearest pivot q, and lies, by
the same inequality taken on squared distances, at most r beyond the bisector
of p and q: (d(y, p)^2 - d(y, q)^2) / (2 d(p, q)) <= r. y is copied to each
cell p that both leave open, so every cell decides alone, and without loss,
the links of the vectors at home in it.

The pivots are the same for all labels, so no label, however many there are,
costs the driver anything. A cell with more than ``BLOCK`` vectors is cut into
units: each block of home rows meets each block of all its rows in a task of
its own, so no task holds more than two blocks.

Equal vectors of one label are one class; its copies are counted, never paired.
Units hand on link counts and a spanning forest, so rows out stay linear.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import Forest, connected_components

#: Pivots of each vector length, the vectors they are chosen from (least hashes), and the lengths that get some (others are one cell a label).
PIVOTS = 4
SAMPLE = 2048
LENGTHS = 16
#: Vectors of a block, and the cells up to which the table of those that are cut is broadcast (24 bytes each).
BLOCK = 8192
BROADCAST_CELLS = 100_000
#: Added to the radius for rounding in distances; links are decided by the cosine itself.
SLACK = 1e-6
_ROWS = 1024


def _unit(flat: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", flat, flat))
    return flat / norms[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different unit vectors, each as far as can be from those before; the first is the first."""
    chosen, square = [0], 2 - 2 * vectors @ vectors[0]
    while len(chosen) < n and square.max() > SLACK:
        chosen.append(int(square.argmax()))
        square = np.minimum(square, 2 - 2 * vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _assign(pivots: dict[int, np.ndarray], radius: float):
    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            dims = batch.column("dim").to_numpy()
            rows, cells, homes = [], [], []
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                p = pivots.get(dim)
                if p is None:
                    rows.append(own)
                    cells.append(np.zeros(len(own), np.int64))
                    homes.append(np.ones(len(own), bool))
                    continue
                between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
                for i in range(0, len(own), _ROWS):
                    part = own[i : i + _ROWS]
                    square = np.maximum(2 - 2 * _unit(_matrix(batch.column("vec").take(pa.array(part)))) @ p.T, 0)
                    home = square.argmin(1)
                    least = square[np.arange(len(part)), home][:, None]
                    open_ = np.sqrt(square) <= np.sqrt(least) + 2 * radius
                    open_ &= square - least <= 2 * radius * between[home] + SLACK
                    open_[np.arange(len(part)), home] = True
                    r, c = np.nonzero(open_)
                    rows.append(part[r])
                    cells.append(c)
                    homes.append(c == home[r])
            rows, cells, homes = np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([out.column("label"), out.column("dim"), pa.array(cells.astype(np.int32)), pa.array(homes), out.column("id"), out.column("copies"), out.column("vec")], ["label", "dim", "cell", "home", "id", "copies", "vec"])

    return run


def in_units(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """``placed`` rows in the units of their cells: ``mine`` and ``all`` say whether a row is looked from and looked at there."""
    cell = ["label", "dim", "cell"]
    blocks = lambda n: F.ceil(n / block).cast("int")
    large = placed.groupBy(*cell).agg(blocks(F.count_if("home")).alias("from_n"), blocks(F.count("*")).alias("to_n")).where("to_n > 1")
    large = C.materialize(large, "large")
    few = large.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    cut = placed.join(F.broadcast(large) if few else large, cell, "left").withColumn("from_n", F.greatest(F.coalesce("from_n", F.lit(1)), F.lit(1))).withColumn("to_n", F.coalesce("to_n", F.lit(1)))
    cut = cut.withColumn("f", F.pmod(F.xxhash64("id"), F.col("from_n"))).withColumn("t", F.pmod(F.xxhash64("id", F.lit(1)), F.col("to_n")))
    # looked at in the units of its own block of all rows; looked from, if at home, in those of its own block of home rows
    seen = F.transform(F.sequence(F.lit(0), F.col("from_n") - 1), lambda k: F.struct(k.cast("long").alias("f"), F.col("t").alias("t")))
    looks = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("to_n") - 1), lambda k: F.struct(F.col("f").alias("f"), k.cast("long").alias("t")))).otherwise(F.array().cast("array<struct<f: bigint, t: bigint>>"))
    units = cut.select(*placed.columns, F.col("f").alias("own_f"), F.col("t").alias("own_t"), F.explode(F.array_union(seen, looks)).alias("u"))
    return units.select(*cell, F.col("u.f").alias("f"), F.col("u.t").alias("t"), (F.col("home") & (F.col("u.f") == F.col("own_f"))).alias("mine"), (F.col("u.t") == F.col("own_t")).alias("all"), "id", "copies", "vec")


_UNIT = ("label", "dim", "cell", "f", "t")


def _join_units(threshold: float):
    def run(it):
        held = None

        def key_of(t: pa.Table) -> np.ndarray:
            return np.stack([t.column(n).to_numpy().astype(np.int64) for n in _UNIT], 1)

        def decide(t: pa.Table):
            key = key_of(t)
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
                part = t.slice(lo, hi - lo)
                ids, copies, mine, seen = (part.column(n).to_numpy() for n in ("id", "copies", "mine", "all"))
                unit = _unit(_matrix(part.column("vec")))
                forest, links = Forest(len(ids)), np.zeros(len(ids), np.int64)
                looks, looked = np.flatnonzero(mine), np.flatnonzero(seen)
                for i in range(0, len(looks), _ROWS):
                    rows = looks[i : i + _ROWS]
                    for j in range(0, len(looked), 4 * _ROWS):
                        others = looked[j : j + 4 * _ROWS]
                        x, y = np.nonzero(unit[rows] @ unit[others].T >= threshold)
                        x, y = rows[x], others[y]
                        x, y = x[x != y], y[x != y]
                        links += np.bincount(x, copies[y], len(ids)).astype(np.int64)
                        forest.link(x, y)
                root = forest.roots()
                tell = mine | (root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[tell]), pa.array(mine[tell]), pa.array(links[tell]), pa.array(ids[root[tell]])], ["id", "mine", "links", "root"])

        for batch in it:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            last = key_of(t.slice(t.num_rows - 1))
            if (key_of(held.slice(0, 1)) == last).all():
                continue
            other = np.flatnonzero((key_of(held) != last).any(1))
            yield from decide(held.slice(0, other[-1] + 1))
            held = held.slice(other[-1] + 1)
        if held is not None:
            yield from decide(held)

    return run


def metric_range_join(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each row.

    Two rows link where their labels are equal and not null and their cosine,
    in double precision, is ``threshold`` or more. A vector that is null,
    empty, zero, or holds a null or non-finite component links with nothing, as
    do vectors of different length. ``n_links`` counts the other rows linked
    directly; ``component_id`` is the smallest id reachable. Rows with a null id
    take part and are no component's smallest unless it has no other. Rows that
    repeat an id are rows of their own. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    C.session_batches(spark)
    rows = C.own(vectors, vec_id=id_col, vec=vec_col, label=label_col).withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("label", F.col("label").cast("long"))
    wide = F.transform("vec", lambda x: x.cast("double"))
    finite = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False)) & F.exists(wide, lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = rows.withColumn("vec", F.when(usable, F.transform(wide, lambda x: x + F.lit(0.0))))
    keyed = rows.withColumn("key", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.to_json(F.struct("vec"))), 256))
    counts = keyed.where("vec is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    # numbered as they are written, so no two classes share an id
    classes = C.materialize(counts.select("*", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("id")), "vectors")
    pivots = {}
    for dim in (r.dim for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()):
        some = classes.where(F.col("dim") == dim).orderBy("key").limit(SAMPLE).select("vec").toArrow().column("vec")
        pivots[dim] = far_apart(_unit(_matrix(some)), PIVOTS)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    placed = classes.select("label", "dim", "id", "copies", "vec").mapInArrow(_assign(pivots, radius), "label long, dim int, cell int, home boolean, id long, copies long, vec array<double>")
    dealt = in_units(C.materialize(placed, "placed")).repartition(C.partitions(spark), *_UNIT).sortWithinPartitions(*_UNIT)
    found = C.materialize(dealt.mapInArrow(_join_units(threshold), "id long, mine boolean, links long, root long"), "cells")
    parts = connected_components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    named = classes.select("key", "id", "copies", "first_id").join(found.where("mine").groupBy("id").agg(F.sum("links").alias("links")), "id").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = named.join(least, "component").select("key", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("grouped"))
    out = keyed.select("vec_id", F.when(F.col("vec").isNotNull(), F.col("key")).alias("key")).join(labels, "key", "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
