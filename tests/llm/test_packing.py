"""Packing against a plain best fit, and a lossless way back."""

import random

import numpy as np
import pytest

from metricloom.llm import packing
from metricloom.llm.queries import END_ID, op2_packing, pre_tokens, ranks_path


def plain(sizes, capacity):
    rows, rooms = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(rows)) if rooms[r] >= sizes[i]]
        if fits:
            row = min(fits, key=lambda r: rooms[r])
        else:
            row = len(rows)
            rows.append([])
            rooms.append(capacity)
        rows[row].append(sizes[i])
        rooms[row] -= sizes[i]
    return sorted(map(sorted, rows))


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(120))]
        got = packing.pack(sizes, capacity)
        assert sorted(i for r in got for i in r) == list(range(len(sizes)))
        assert len(got) == len(plain(sizes, capacity)) and all(sum(sizes[i] for i in r) <= capacity for r in got)
        assert sorted(sorted(sizes[i] for i in r) for r in got) == plain(sizes, capacity) or sorted(capacity - sum(sizes[i] for i in r) for r in got) == sorted(capacity - sum(r) for r in plain(sizes, capacity))


def check(spark, docs, rows, capacity):
    import tiktoken

    from metricloom.llm.bpe import load_ranks

    own = tiktoken.Encoding("t", pat_str=pre_tokens(), mergeable_ranks=load_ranks(ranks_path()), special_tokens={})
    got = rows.collect()
    ids, positions = packing.matrix(got, "ids", END_ID), packing.matrix(got, "position_ids", END_ID)
    assert ids.shape == positions.shape == (len(got), capacity) and len({r.pack_id for r in got}) == len(got)
    for r, p in zip(got, positions, strict=True):
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and [s.length for s in r.segments] == np.diff(r.cu_seqlens).tolist()
        assert p[: r.n_tokens].tolist() == [i for n in np.diff(r.cu_seqlens) for i in range(n)]
    back = sorted((str(r.key), list(r.ids)) for r in packing.unpacked(rows, END_ID, capacity).collect())
    assert back == sorted((str(d.doc_id), own.encode_ordinary(d.text or "")) for d in docs.collect())


def test_query_loses_nothing(spark, sf_dir):
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), op2_packing(spark, sf_dir), packing.CAPACITY)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, 1, "x"), (2, "", 2, "x"), (None, "a b c", 3, None), (4, "same", 1, "x"), (4, "same", 1, "x"), (5, "long text " * 3000, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, row string")
    for capacity in (1, 16):
        out = packing.packed(docs, ranks_path(), pre_tokens(), END_ID, capacity=capacity, pool_tokens=50)
        check(spark, docs, out, capacity)
    packing.write(out, str(tmp_path / "matrix"))
    assert spark.read.parquet(str(tmp_path / "matrix")).count() == out.count()
    assert packing.packed(docs.limit(0), ranks_path(), pre_tokens(), END_ID).collect() == []
