"""Encoding against the tiktoken library, and the way back."""

import hashlib
import random

import pytest
import tiktoken

from metricloom.llm import bpe
from metricloom.llm.queries import op1_bpe, pre_tokens, ranks_path


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(ranks_path())
    return bpe.BytePairs(ranks, pre_tokens()), tiktoken.Encoding("t", pat_str=pre_tokens(), mergeable_ranks=ranks, special_tokens={})


def test_queue_order():
    queue, rng = bpe.RankQueue(), random.Random(1)
    ranks = [rng.randrange(50_000) for _ in range(500)]
    for r in ranks:
        queue.push(r, None)
    out = []
    while (r := queue.first()) >= 0:
        out += [r] * len(queue.take(r))
    assert out == sorted(ranks)


def test_texts(both):
    own, other = both
    rng = random.Random(2)
    texts = ["", "a", "aaaaaaaaa", "ab" * 200, "<|endoftext|>", "it's we'll", "\n\n  x \t\n", "漢字 ñandú éé", "x" * 20_000, "".join(rng.choice("etaoin shrdlu.\n1") for _ in range(4000)), "".join(chr(rng.randrange(1, 0x2FF)) for _ in range(3000))]
    wanted = [other.encode_ordinary(t) for t in texts]
    assert list(own.encode_texts(texts)) == wanted
    assert [own.decode(i) for i in wanted] == [t.encode() for t in texts]
    assert [[i for p in own.split(t) for i in own.encode_one(p.encode())] for t in texts] == wanted


def test_query_and_frames(spark, sf_dir, both):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf_dir).collect():
        ids = both[1].encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    rows = [(1, None, "x"), (None, "", None), (2, "two words", ""), (2, "two words", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(frame, ranks_path(), pre_tokens())
    assert sorted((r.doc_id or 0, len(r.ids)) for r in out.collect()) == [(0, 0), (1, 0), (2, 2), (2, 2)]
    assert {bytes(r.decoded).decode() for r in bpe.decode(out, ranks_path(), pre_tokens()).collect()} == {"", "two words"}
    assert bpe.encode(frame.limit(0), ranks_path(), pre_tokens()).collect() == [] and bpe.round_trip(frame, ranks_path(), pre_tokens()).count() == 4
