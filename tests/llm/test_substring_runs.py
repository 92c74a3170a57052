"""Runs of found windows as Arrow lists: many in one batch, missing and sliced rows."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lynceus.llm import substrings

RUN = pa.struct([("start", pa.int32()), ("size", pa.int32())])


def test_a_batch_of_many_runs_stays_small():
    """A batch of 8 MB holds a million runs, which as Python objects took 280 MB in each worker."""
    rows, each = 5000, 100
    runs = pa.StructArray.from_arrays(
        [pa.array(np.tile(np.arange(each), rows), pa.int32()), pa.array(np.ones(rows * each), pa.int32())], fields=list(RUN)
    )
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * each + 1, each), pa.int32()), runs)
    texts = pa.array(["a " * 160] * rows)
    tracemalloc.start()
    cut = substrings.cut_texts(50)(texts, lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    assert cut.field("n_removed").to_pylist() == [149] * rows


def test_missing_and_sliced_runs():
    lists = pa.array([[(0, 1)], None, [], [(2, 1), (0, 2)]], pa.list_(RUN)).slice(1)
    texts = pa.array([None, "a b c", "a b c d"])
    cut = substrings.cut_texts(2)(texts, lists).to_pylist()
    assert [(c["n_words"], c["n_removed"], c["kept"]) for c in cut] == [(0, 0, ""), (3, 0, "a b c"), (4, 4, "")]
    assert [s.tolist() for s, _ in substrings.run_arrays(lists)] == [[], [], [2, 0]]
