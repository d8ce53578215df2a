"""Template mining on DataFrames: exact within each group, groups in parallel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.drain import Drain

_OUT = "group_id long, event_order long, event_id long, cluster_id long, cluster_size long, change_type string, template string"


def mine(lines: DataFrame, group: str, sim_th: float = 0.4, depth: int = 4) -> DataFrame:
    """Mine each group of lines (a window, a block, a source) with a miner of its own, in ``event_order``.

    ``template`` is the one mined at that line. One group is one task's work:
    choose groups that are bounded (windows, blocks), as order matters within.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        miner, rows = Drain(sim_th=sim_th, depth=depth), []
        for r in pdf.sort_values(["event_order", "event_id"]).itertuples():
            c, change = miner.add(r.message or "")
            rows.append((r.group_id, r.event_order, r.event_id, c.cluster_id, c.size, change, c.template))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")])

    picked = lines.select(F.col(group).cast("long").alias("group_id"), "event_order", "event_id", "message")
    return picked.groupBy("group_id").applyInPandas(run, _OUT)


def match_reference(lines: DataFrame, miner: Drain, full_search: bool = True) -> DataFrame:
    """Match lines against a frozen miner (at most ``max_clusters`` templates travel); stateless and parallel."""

    def run(it):
        for pdf in it:
            found = [miner.match(m or "", full_search) for m in pdf["message"]]
            yield pd.DataFrame({"event_id": pdf["event_id"], "matched_cluster_id": pd.array([c.cluster_id if c else None for c in found], "Int64"), "matched_template": [c.template if c else None for c in found], "is_known_template": [c is not None for c in found]})

    return lines.select("event_id", "message").mapInPandas(run, "event_id long, matched_cluster_id long, matched_template string, is_known_template boolean")


def warm(history: DataFrame, limit: int | None = None, **settings) -> Drain:
    """A miner that has learnt all history lines in order, or the first ``limit``.

    Order makes this serial: lines stream through the driver, which holds the miner's clusters alone.
    """
    miner = Drain(**settings)
    ordered = history.orderBy("event_order")
    for r in (ordered if limit is None else ordered.limit(limit)).select("message").toLocalIterator():
        miner.add(r.message or "")
    return miner
