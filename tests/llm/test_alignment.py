"""The alignment of two tokenizers against a loop over whole encodings, and counts against a plain count."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from metricloom.llm import alignment
from metricloom.llm.queries import op11_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, k string, block int, pairs string"
ODD = [
    "", None, "a", "▁a b", "<|endoftext|> x", "foo\n  bar\n\n", "　 x　", "x\x00y \x1c z\x85 q", "ＡＢ ﬁ é", " lead", "\n", "\n\n a", "tab\t\tx", "日本語 テキスト", "a" * 5000,
    "🙂🙂 x", "<s> <0x41>", "<unk> z", "x;\r\ny {\r\n\r\n}", "end  ", "it's 12,345.67 o'clock", "\r", " \r \r x\r", "w " * 3000,
]


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteLevel(A), alignment.Pieces(B)


def one(text, sides):
    """Ids of both, groups and linked pairs by a loop over bytes; nothing where the bytes differ."""
    if not text:
        return None
    a, b = sides[0].own.encode(f" {text}", add_special_tokens=False).ids, sides[1].own.encode(text)
    parts = [[s.data[i] for i in ids] for s, ids in zip(sides, (a, b), strict=True)]
    if not b"".join(parts[0]) == b"".join(parts[1]) == f" {text}".encode():
        return None
    i = j = at_a = at_b = 0
    groups, links, mine, other = [], [], [], []
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = at_a + len(parts[0][i]), at_b + len(parts[1][j])
        if x <= y:
            mine, i, at_a = [*mine, a[i]], i + 1, x
        if y <= x:
            other, j, at_b = [*other, b[j]], j + 1, y
        if x == y:
            groups.append(f"{','.join(map(str, mine))}|{','.join(map(str, other))}")
            mine, other = [], []
    return len(a), len(b), groups, links


def brute(rows, sides):
    found = [(k, one(t, sides)) for k, t in rows]
    held = Counter(p for _, x in found if x for p in set(x[3]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for k, x in found:
        if x is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            out.append((k, n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def results(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def test_query_against_a_loop(spark, sf_dir, sides):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert results(op11_alignment(spark, sf_dir)) == brute(rows, sides)


def test_odd_rows(spark, sides, monkeypatch):
    rows = [*enumerate(ODD), (3, ODD[3]), (5, ODD[5]), (None, "a"), (None, None)]
    frame = lambda r: spark.createDataFrame([(*x, "q", 1, "p") for x in r], SCHEMA)
    assert results(alignment.digest(frame(rows).repartition(3), A, B)) == brute(rows, sides)
    assert results(alignment.digest(frame(rows[:2]), A, B)) == brute(rows[:2], sides)
    assert alignment.digest(frame([]), A, B).collect() == []


def test_small_blocks_lanes_and_stores(sides, monkeypatch):
    monkeypatch.setattr(alignment, "LANE_WORDS", 3)
    monkeypatch.setattr(alignment, "STORE_WORDS", 5)
    known = alignment.Store(*sides)
    for texts in (ODD, ODD[::-1], ["▁a b", "x y z w v"] * 3):
        block = alignment.Block(texts, known)
        for text, got, n_a in zip(texts, block.groups(), block.n[0], strict=True):
            x = one(text, sides)
            assert (int(n_a), got.decode()) == ((x[0], ";".join(x[2])) if x else (0, ""))


def test_whole_texts_where_words_do_not_stand_alone(sides):
    known = alignment.Store(*sides)
    known.words = lambda text: [text]
    block = alignment.Block(ODD, known)
    assert [g.decode() for g in block.groups()] == [";".join(x[2]) if x else "" for x in (one(t, sides) for t in ODD)]


def test_links_and_cuts(spark, sides):
    rows = [*enumerate(ODD), (None, "some text")]
    for r in alignment.links(spark.createDataFrame([(*x, "q", 1, "p") for x in rows], SCHEMA), A, B).collect():
        x = one(dict(rows)[r.doc_id], sides)
        assert bool(r.a_ids) == (x is not None)
        if x:
            assert sorted(zip((r.a_ids[i] for i in r.link_a), (r.b_ids[i] for i in r.link_b), strict=True)) == sorted(x[3])
            assert [r.a_ends[i] for i in r.cut_a] == [r.b_ends[i] for i in r.cut_b] == sorted(set(r.a_ends) & set(r.b_ends))
            assert r.a_ends[-1] == r.b_ends[-1] == len(f" {dict(rows)[r.doc_id]}".encode())


def test_translations(spark, sides):
    rows = [(1, "the cat"), (2, "the dog"), (3, "the cat")]
    got = {(r.a, r.b): (r.n, r.best) for r in alignment.translations(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    held = Counter(p for _, t in rows for p in set(one(t, sides)[3]))
    assert {p: n for p, (n, _) in got.items()} == held
    assert all(best == (n == max(m for q, m in held.items() if q[0] == p[0])) for p, (n, best) in got.items())


def test_lanes_end_where_tokens_do():
    a, b = np.array([2, 4, 5, 8, 9]), np.array([4, 5, 6, 9])
    got = alignment.lockstep(a, b, np.array([0, 3, 3]), np.array([3, 3, 5]), np.array([0, 2, 2]))
    assert sorted(zip(got[0].tolist(), got[1].tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (3, 2), (3, 3), (4, 3)]
    assert sorted(zip(got[2].tolist(), got[3].tolist(), strict=True)) == [(1, 0), (2, 1), (4, 3)]
