"""What the review found missing in the log operators: each test fails on the version before its fix."""

from __future__ import annotations

import numpy as np
import pytest

from logtide.functions import extremes
from logtide.operators import pot


def test_pot_fits_all_excesses(spark):
    """More than 100,000 excesses, tied and of two kinds."""
    m = spark.range(260_000).selectExpr("id as event_id", "id % 7 as window_id", "cast(case when id % 1000 = 3 then 50 + id % 17 else round(-ln(1 - (id % 9973) / 9974.0), 2) end as double) as v")
    want = extremes.pot_fit(m.toPandas()["v"], 0.3, 0.1)
    got = pot.global_pot(m, "v", 0.3, 0.1)
    assert want["num_exceedances"] > 100_000
    for k, x in want.items():
        assert got[k] == pytest.approx(x, rel=1e-9), k
    assert np.isfinite(got["threshold_z"])
