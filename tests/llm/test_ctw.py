"""Context-tree weighting against a plain recursive tree, and base scores against plain counts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from metricloom.llm import ctw
from metricloom.llm.queries import op4_ctw

SCHEMA = "k long, text string, train string, block int"


class Plain:
    """Nodes by context and known bits in a dictionary."""

    def __init__(self, texts, depth=ctw.DEPTH):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for x in texts:
            for context, byte in self.steps(x):
                for d in range(depth + 1):
                    c, bits = context[depth - d :], ""
                    for b in f"{byte:08b}":
                        self.n[c, bits][int(b)] += 1
                        if d < depth:
                            self.children[c, bits].add((context[depth - d - 1 :], bits))
                        bits += b
        self.memo = {}

    def steps(self, x):
        x = bytes(self.depth) + x + b"\0"
        return [(x[i - self.depth : i], x[i]) for i in range(self.depth, len(x))]

    def own(self, node):
        a, b = self.n[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def total(self, node):
        if node not in self.memo:
            own = self.own(node)
            if len(node[0]) == self.depth:
                self.memo[node] = own
            else:
                self.memo[node] = np.logaddexp(own, sum(self.total(c) for c in self.children[node])) - math.log(2)
        return self.memo[node]

    def p(self, context, bits, bit, d=0):
        node = (context[self.depth - d :], bits)
        if node not in self.n:
            return 0.5
        counts = self.n[node]
        own = (counts[bit] + 0.5) / (sum(counts) + 1)
        if d == self.depth:
            return own
        further = self.p(context, bits, bit, d + 1)
        w = math.exp(self.own(node) - math.log(2) - self.total(node))
        return w * own + (1 - w) * further

    def score(self, x):
        out = 0.0
        for context, byte in self.steps(x):
            bits = ""
            for b in f"{byte:08b}":
                out += math.log10(self.p(context, bits, int(b)))
                bits += b
        return out


def lower(t):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())


def base(rows):
    """(key, text, train) to token counts and scores."""
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", lower(t)), None] for _, t, _ in rows]
    counts = Counter(w for (_, _, train), ws in zip(rows, tokens, strict=True) if train for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(k, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for (k, _, _), ws in zip(rows, tokens, strict=True)]


@pytest.mark.parametrize("block_bytes", [ctw.BLOCK_BYTES, 300])
def test_against_a_plain_tree(spark, block_bytes):
    texts = ["the cat sat on the mat", "The hat!", None, "", "été à la mer\n", "the the the the cat", "zq" * 40, "on the mat the cat sat", "a b a b a c", "the cat sat on the mat"]
    rows = [(i, t, i % 4 != 1) for i, t in enumerate(texts * 3)] + [(None, "the cat", False)]
    frame = spark.createDataFrame([(k, t, str(train), 3) for k, t, train in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in ctw.score(frame, frame.train == "True", "k", block_bytes=block_bytes).collect()), key=lambda r: (r[0] is None, r[0]))
    got2 = sorted((tuple(r) for r in ctw.score(frame.repartition(5), frame.train == "True", "k", block_bytes=block_bytes, part_strings=50).collect()), key=lambda r: (r[0] is None, r[0]))
    assert [r[:4] for r in got2] == [r[:4] for r in got] and all(a[5] == pytest.approx(b[5], rel=1e-5) for a, b in zip(got, got2, strict=True))
    plain = Plain([lower(t) for _, t, train in rows if train])
    for r, b, (k, t, _) in zip(got, base(rows), rows, strict=True):
        assert r[:4] == b[:4] and r[0] == k
        assert r[4] == pytest.approx(b[4]) and r[5] == pytest.approx(plain.score(lower(t)), rel=1e-5)


def test_no_training_rows_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "ab", "", 1), (2, None, "", 1)], SCHEMA)
    got = {r.k: r for r in ctw.score(frame, frame.train == "x", "k").collect()}
    assert got[1].score == pytest.approx(24 * math.log10(0.5), rel=2e-5) and got[2].score == pytest.approx(8 * math.log10(0.5), rel=2e-5) and got[1].base_score == 0 and got[1].train_tokens == 0
    assert ctw.score(frame.limit(0), frame.train == "x", "k").collect() == []


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    wanted = {b[0]: b for b in base(rows)}
    got = op4_ctw(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(wanted)
    assert {r.doc_id: r.held_out for r in got} == {k: not train for k, _, train in rows}
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == wanted[r.doc_id][1:4] and r.base_score == pytest.approx(wanted[r.doc_id][4])
    held = [r for r in got if r.held_out]
    # 160 documents to learn from: words tell more than six bytes; the more there are, the less so
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 1.12
    assert all(r.score < 0 for r in got)
    held = [r for r in op4_ctw(spark, sf_dir.replace("0.001", "0.01")).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 1.003
