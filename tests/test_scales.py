"""Scales are tried on a bounded number of points at once."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from burrow.operators import tracks

CORNERS = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (0.0, 1.0))]


def batch(n):
    r = np.random.default_rng(3)
    columns = [pa.array(r.integers(0, n // 50 + 1, n)), pa.array(np.full(n, 1.25)), pa.array(r.uniform(0, 2, n)), pa.array(r.uniform(0, 2, n)), pa.array([CORNERS if i % 9 else None for i in range(n)])]
    return pa.RecordBatch.from_arrays(columns, names=["session", "lo", "x", "y", "polygon"])


def test_hits_are_those_of_every_point():
    b = batch(3000)
    hits, scored = Counter(), Counter()
    for got in tracks._tried_scales(iter([b, b.slice(0, 0)])):
        for r in got.to_pylist():
            hits[r["session"], r["k"]] += r["hits"]
            scored[r["session"], r["k"]] += r["scored"]
    session, _, x, y, polygon = (b.column(c).to_pylist() for c in range(5))
    for k in (1.25, 1.9, 3.25):
        want = Counter({s: 0 for s in session})
        for s, px, py, p in zip(session, x, y, polygon):
            want[s] += bool(p) and px / k < 0.5 and py / k < 1
        assert {s: hits[s, k] for s in want} == dict(want)
        assert {s: scored[s, k] for s in want} == dict(Counter(session))
    assert len(scored) == 201 * len(set(session))


def test_memory_does_not_grow_with_the_batch():
    b = batch(10_000)
    tracemalloc.start()
    for got in tracks._tried_scales(iter([b])):
        assert got.num_rows <= 201 * 1024
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20  # 72 MB with all points at once


def test_half_scales_are_rounded_up():
    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1.235]), pa.array([0.1]), pa.array([0.1]), pa.array([CORNERS])], names=["session", "lo", "x", "y", "polygon"])
    (got,) = tracks._tried_scales(iter([b]))
    k = got.column("k").to_pylist()
    assert k[0] == 1.24 and 1.29 in k
