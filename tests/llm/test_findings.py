"""What a later review found missing in the text operators: each test fails on the version before its fix."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from logtide.llm import common as C


def _held() -> int:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10


def test_workers_give_back_memory():
    """Freed arrays below one that stays are returned when a batch is done."""
    parts = [np.ones(12_000) for _ in range(2_500)]  # 96 KB each, so on the heap
    last = np.ones(12_000)
    full = _held()
    del parts
    assert [b.num_rows for b in C.batches(iter([pa.record_batch([pa.array(["a b"] * 10)], ["text"])]), ["text"])] == [10]
    assert _held() < full - 150 and last.sum() == 12_000
