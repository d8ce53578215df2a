"""Driver tables as ordered log records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BLOCK = 1000
UNKNOWN = "<unknown>"


def events_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table in the record schema.

    ``event_order`` is the dense position in the stream and a column from the
    scan on; nothing ever relies on row order.
    """
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id as event_order",
        "event_id",
        "ts",
        "concat(event_type, ' user ', user_id, ' value ', cast(cast(value as decimal(18,2)) as string), ' props ', props) as message",
        "case when event_type = 'error' and value >= 200 then 1 else 0 end as label",
        "concat(event_type, ' k', cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 10, ' v', cast(floor(value / 20) as bigint)) as template",
        "'events' as source",
        f"event_id div {BLOCK} as block_id",
    )
