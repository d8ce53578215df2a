"""Peaks over threshold on windows' event scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extremes import gpd_profile, gpd_thetas, pot_fit
from .extremes import order_statistic


def _emit_shapes(u: float, thetas: np.ndarray):
    """Sums of count * log1p(theta * excess) over a partition's distinct values, for every theta."""

    def run(it):
        sums = np.zeros(len(thetas))
        for pdf in it:
            x, m = pdf["value"].to_numpy(float) - u, pdf["m"].to_numpy(float)
            for i in range(0, len(x), 2000):
                sums += np.log1p(np.outer(thetas, x[i : i + 2000])) @ m[i : i + 2000]
        yield pd.DataFrame({"k": np.arange(len(thetas)), "s": sums})

    return run


def global_pot(members: DataFrame, score: str, quantile: float = 0.95, tail: float = 0.1) -> dict:
    """One fit over all rows. u is exact; the law is fitted on all excesses, by distinct value and count."""
    u = order_statistic(members, score, quantile).first()["u"]
    over = members.select(F.col(score).cast("double").alias("value")).where(F.col("value") > u).groupBy("value").agg(F.count("*").alias("m"))
    x = F.col("value") - F.lit(float(u or 0))
    n, mean, top = over.agg(F.sum("m"), F.sum(x * F.col("m")) / F.sum("m"), F.max(x)).first()
    if not n:
        raise ValueError("no exceedances")
    thetas = gpd_thetas(mean, top)
    sums = over.mapInPandas(_emit_shapes(float(u), thetas), "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").toPandas()["s"].to_numpy(float)
    xi, sigma = gpd_profile(n, mean, thetas, sums / n)
    z = u + (sigma / xi * (tail**-xi - 1) if abs(xi) > 1e-9 else -sigma * math.log(tail))
    return {"threshold_u": u, "threshold_z": z, "gpd_shape": xi, "gpd_scale": sigma, "num_exceedances": n}


def refine(members: DataFrame, score: str, fit: dict, suspicious: DataFrame | None = None) -> DataFrame:
    """Candidates of each window: rows above z; ``suspicious`` (window_id) limits it to some windows."""
    x = members.join(suspicious.select("window_id"), "window_id", "left_semi") if suspicious is not None else members
    hit = F.col(score) > fit["threshold_z"]
    return x.groupBy("window_id").agg(F.count_if(F.col(score) > fit["threshold_u"]).alias("num_exceedances"), F.count_if(hit).alias("num_candidates"), F.array_sort(F.collect_list(F.when(hit, F.col("event_id")))).alias("candidate_event_ids"), F.max(F.when(hit, 1).otherwise(0)).cast("boolean").alias("pot_suspicious"))


def per_window_pot(members: DataFrame, score: str, quantile: float = 0.6, tail: float = 0.3, least: int = 1) -> DataFrame:
    """A fit for each window; windows with fewer than ``least`` exceedances are not refined."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            fit = pot_fit(pdf["score"].to_numpy(), quantile, tail)
        except ValueError:
            fit = None
        if fit is None or fit["num_exceedances"] < least:
            return pd.DataFrame([], columns=["window_id", "threshold_u", "threshold_z", "num_exceedances", "num_candidates"])
        n = int((pdf["score"] > fit["threshold_z"]).sum())
        return pd.DataFrame([(pdf["window_id"].iloc[0], fit["threshold_u"], fit["threshold_z"], fit["num_exceedances"], n)], columns=["window_id", "threshold_u", "threshold_z", "num_exceedances", "num_candidates"])

    return members.select("window_id", F.col(score).cast("double").alias("score")).groupBy("window_id").applyInPandas(run, "window_id long, threshold_u double, threshold_z double, num_exceedances long, num_candidates long")
