"""The whole analysis from a configuration: load, parse, window, score, refine, evaluate."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as K
from ..operators import extremes as X
from ..operators import parsing, pot
from ..operators import stream as S
from ..operators import windows as W
from ..sources.adapters import events_as_logs
from ..sources.loaders import load_logs


@dataclass(frozen=True)
class Settings:
    """Defaults are the standard configuration."""

    dataset: str = "events"
    path: str = ""
    history: float = 0.3
    rare: int = 2
    size: int = 100
    stride: int = 50
    mode: str = "count"
    hours: float = 6.0
    stride_hours: float = 3.0
    group_key: str = "block_id"
    mine_by: str | None = None
    alpha: float = 0.9
    statistics: tuple[str, ...] = field(default=X.ENSEMBLE)
    pot_enabled: bool = False
    pot_quantile: float = 0.95
    pot_tail: float = 0.1
    pot_score: str = "novelty_score"


def load_settings(path: str) -> Settings:
    """From a YAML file of the fields' names."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    if "statistics" in raw and isinstance(raw["statistics"], str):
        raw["statistics"] = tuple(s.strip() for s in raw["statistics"].split(","))
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def positioned(records: DataFrame) -> DataFrame:
    """Records with the dense 0-based ``event_order`` that windows rest on."""
    return S.ordinal(records, "event_order").withColumn("event_order", F.col("ord")).drop("ord")


def run(spark: SparkSession, settings: Settings) -> dict[str, DataFrame]:
    """Frames by name: members, features, windows, candidates, evaluation, and pot where it is on and finds exceedances. All lazy."""
    if settings.dataset == "events":
        logs = events_as_logs(spark, settings.path)
    else:
        logs = positioned(load_logs(spark, settings.dataset, settings.path))
    if settings.mine_by:
        mined = parsing.mine(logs, settings.mine_by).select("event_id", F.col("template").alias("_mined"))
        logs = logs.join(mined, "event_id").withColumn("template", F.col("_mined")).drop("_mined")
    else:
        logs = logs.withColumn("template", F.coalesce("template", S.mask(F.col("message"))))
    stream = S.novelty(*S.split_history(logs, settings.history), settings.rare)
    if settings.mode == "group":
        groups = W.group_windows(stream, settings.group_key).select(settings.group_key, "window_id")
        members = stream.join(groups, settings.group_key)
    elif settings.mode == "time":
        members = W.time_windows(stream, settings.hours, settings.stride_hours)
    else:
        members = W.count_windows(stream, settings.size, settings.stride)
    features = W.window_features(members)
    windows = X.ensemble(X.gev_scores(features, settings.statistics, settings.alpha))
    out = {"members": members, "features": features, "windows": windows, "candidates": K.event_candidates(members, windows.drop("window_label", "num_anomalous").join(features, "window_id")), "evaluation": X.evaluate_windows(windows, members)}
    if settings.pot_enabled:
        try:
            fit = pot.global_pot(members, settings.pot_score, settings.pot_quantile, settings.pot_tail)
        except ValueError:  # nothing lies above the threshold: windows stay unrefined
            return out
        out["pot"] = pot.refine(members, settings.pot_score, fit, windows.where("is_suspicious"))
    return out
