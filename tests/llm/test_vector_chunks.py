"""Chunks of vectors: what is written, and pairs against plain products."""

import os
from urllib.parse import urlparse

import numpy as np
import pytest

from lynceus.llm import embeddings as E


def test_vectors_are_written_once(spark):
    """Each vector was once written to a grid cell of each block and its neighbours, then to every pair of chunks of a cell."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 32)))]
    df = spark.createDataFrame(rows + [(2000 + i, rows[i][1]) for i in range(20)], "vec_id bigint, embedding array<double>")
    base = urlparse(spark.conf.get("spark.checkpoint.dir")).path
    before = set(os.listdir(base))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_links(df).collect()}
    written = sum(os.path.getsize(os.path.join(d, f)) for n in set(os.listdir(base)) - before for d, _, files in os.walk(os.path.join(base, n)) for f in files)
    assert written < 2 * 1500 * 32 * 8
    assert got[3] == (1, 3, True) and got[2003] == (1, 3, False) and got[1000] == (0, 1000, True) and len(got) == 1520


@pytest.mark.parametrize("dims", [1, 3, 64, 200])
def test_pairs_of_chunks_are_those_of_plain_products(dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(60, dims))
    rows = np.concatenate([base[rng.integers(0, 60, 1400)] + rng.normal(size=(1400, dims)) * s for s in (0.1, 0.3)])
    order = np.argsort(E.cells(rows, 0.95), kind="stable")
    unit = E._unit(rows[order])
    want = unit @ unit.T >= 0.95
    assert np.abs(np.abs(unit @ unit.T) - 0.95).min() > 1e-12
    got = np.zeros_like(want)
    whole, a, b = (E._Held(rows[order][x]) for x in (slice(None), slice(0, 1300), slice(1300, None)))
    for p, q in E.near_pairs(whole, None, 0.95):
        got[p, q] = True
    assert (got == np.triu(want, 1)).all()
    got[:] = False
    for p, q in E.near_pairs(a, b, 0.95):
        got[p, q + 1300] = True
    assert (got[:1300, 1300:] == want[:1300, 1300:]).all()


def test_a_vector_has_one_cell_in_any_batch():
    rows = np.random.default_rng(7).normal(size=(400, 24))
    rows[::2] = rows[0]
    whole = E.cells(rows, 0.95)
    assert len(set(whole[::2].tolist())) == 1
    assert all(E.cells(rows[i : i + 3], 0.95).tolist() == whole[i : i + 3].tolist() for i in range(0, 400, 3))
