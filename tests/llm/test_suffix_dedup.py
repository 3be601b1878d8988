"""Repeated strings against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from metricloom.llm import suffix_dedup as sd
from metricloom.llm.queries import op7_suffix_dedup

SCHEMA = "doc_id long, text string, row int, ranges string"


def brute(rows, length):
    seen = {}
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, x in data:
        for i in range(len(x) - length + 1):
            w = hash(x[i : i + length])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for k, x in data:
        gone = np.zeros(len(x) + 2, bool)
        for i in range(len(x) - length + 1):
            if seen[hash(x[i : i + length])] > 1:
                gone[i + 1 : i + 1 + length] = True
        inner = gone[1:-1]
        kept = np.frombuffer(x, np.uint8)[~inner].tobytes()
        out.append((k, len(x), int(inner.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r))


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r))


def corpus():
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage, other = noise(300), noise(130)
    rows = [(i, noise(rng.randrange(200)) + (passage if i % 3 == 0 else other if i % 3 == 1 else "") + noise(rng.randrange(200))) for i in range(60)]
    base = noise(600)
    for i in range(30):  # near copies
        at = rng.randrange(600)
        rows.append((100 + i, base[:at] + "X" + base[at + 1 :]))
    rows += [(200, base), (200, base), (201, None), (None, passage[:99]), (None, passage[:100]), (202, ""), (203, "a" * 900), (204, "ab" * 300), (205, other * 3), (206, noise(5000))]
    return rows


@pytest.mark.parametrize("anchor_pieces", [sd.ANCHOR_PIECES, 5])
def test_against_all_windows(spark, anchor_pieces):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert results(sd.digest(sd.dedup(frame, length=100, anchor_pieces=anchor_pieces))) == brute(rows, 100)


def test_query_against_all_windows(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    wanted = brute(rows, 400)
    assert results(op7_suffix_dedup(spark, sf_dir)) == wanted
    assert any(r[2] for r in wanted)


def test_empty(spark):
    assert sd.dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in sd.digest(sd.dedup(spark.createDataFrame([(1, None, 1, None)], SCHEMA))).collect()] == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_matching_statistics_of_the_index():
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 60))) for _ in range(25)] + [b"abab" * 9, b"abab" * 9, b"a" * 30]
    index = sd.RunIndex(pieces)
    assert len(index.run_starts) < len(index.text)
    suffixes = [p[i:] for p in pieces for i in range(len(p))]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    wanted = [max(common(s, t) for j, t in enumerate(suffixes) if j != i) for i, s in enumerate(suffixes)]
    assert index.matching().tolist() == wanted


def test_a_long_text_is_cut_with_overlap(monkeypatch):
    text = bytes(random.Random(1).choice(b"abcdefgh") for _ in range(3000))
    whole = sd.cut(text, np.array([0]), 100)
    assert whole[1][0] == 0 and whole[2][-1] == 2900 and (whole[1][1:] == whole[2][:-1] + 1).all()
