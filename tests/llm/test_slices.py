"""Slices that bound how much text an operator works on at a time."""

import numpy as np
import pyarrow as pa

from tarnbeck.llm import toxicity as X
from tarnbeck.llm.common import shingle_sets, slices

TEXTS = ["é" * 5, None, "", "x" * 100, "ab", "cd", None, "y" * 30, "z" * 30] * 3


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["k", "t"])


def test_slices_keep_rows_and_bound_bytes():
    batches = [batch(t) for t in (TEXTS, [], [None], TEXTS[3:4])]
    for rows, size in ((1, 1), (2, 64), (100, 40), (100, 1000), (4, 1 << 30)):
        out = list(slices(batches, 1, rows, size))
        assert [r for b in out for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
        assert all(b.num_rows == 1 or b.num_rows <= rows and sum(len((x or "").encode()) for x in b.column(1).to_pylist()) <= size for b in out)


def test_slices_are_as_long_as_they_may_be():
    assert [b.num_rows for b in slices([batch(TEXTS[:9])], "t", 100, 60)] == [3, 1, 4, 1]


def test_sets_and_features_do_not_depend_on_the_slices():
    b = batch([None if i % 7 == 0 else f"word{i % 5} " * (1 + 40 * (i % 3)) + f"tail {i}" for i in range(60)])
    for of in (lambda c: [s.tolist() for s in shingle_sets(c)], lambda c: [np.unique(f[own == i]).tolist() for f, own in [X.features(c)] for i in range(len(c))]):
        assert of(b.column(1)) == [r for s in slices([b], 1, 1000, 50) for r in of(s.column(1))]
