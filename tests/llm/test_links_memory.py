"""What a task holds while it confirms pairs is bounded, however many pairs a batch has."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from kgspark.llm import _links


def test_confirming_holds_little():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 350)) for _ in range(1200)]
    pairs = pa.record_batch([pa.array(range(1200)), pa.array(range(1200)), pa.array(texts), pa.array([t + " end" for t in texts])], ["a", "b", "text_a", "text_b"])
    tracemalloc.start()
    (got,) = _links._confirm(75)(iter([pairs]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 1200
    assert peak < 40e6, peak
