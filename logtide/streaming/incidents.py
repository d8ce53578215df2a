"""The incident buffer on a stream: one open incident a block, closed by the next seed that is too far."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "block_id long, start_order long, end_order long, seed_events long, templates long, max_burst double, max_novelty double, is_open boolean"
_STATE = "start_order long, end_order long, seed_events long, templates string, max_burst double, max_novelty double"


def incident_stream(seeds: DataFrame, max_gap: int = 50, close_after: int = 50) -> DataFrame:
    """Closed incidents as they close, and each block's open one again at every batch (``is_open``); the last of a block is its state.

    State is one small row a block. Seeds of a block must arrive in order, as
    from a log shipped by block; a late seed (before the open incident's last
    one) joins the open incident.
    """
    gap = min(max_gap, close_after)

    def step(key, batches, state):
        now = state.get if state.exists else None
        rows = []
        for r in pd.concat(list(batches)).sort_values(["event_order", "event_id"]).itertuples():
            if now is not None and r.event_order - now[1] > gap:
                rows.append((key[0], now[0], now[1], now[2], len(set(now[3].split("\x1f"))), now[4], now[5], False))
                now = None
            if now is None:
                now = (r.event_order, r.event_order, 1, r.template or "", r.template_burst_score, r.novelty_score)
            else:
                names = now[3] if (r.template or "") in now[3].split("\x1f") else f"{now[3]}\x1f{r.template or ''}"
                now = (min(now[0], r.event_order), max(now[1], r.event_order), now[2] + 1, names, max(now[4], r.template_burst_score), max(now[5], r.novelty_score))
        state.update(now)
        rows.append((key[0], now[0], now[1], now[2], len(set(now[3].split("\x1f"))), now[4], now[5], True))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    picked = seeds.select("block_id", "event_order", "event_id", "template", "template_burst_score", "novelty_score")
    return picked.groupBy("block_id").applyInPandasWithState(step, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(seeds: DataFrame, name: str, checkpoint: str, **settings) -> None:
    """Run the stream over what is available into the memory table ``name``."""
    q = incident_stream(seeds, **settings).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events once each within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Event-time sliding counts with late data dropped behind the watermark."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", delay).groupBy(F.window("ts", size, step), "source").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))
