"""Trees, located edits and the query against a plain loop over all documents."""

import hashlib

from metricloom.llm import merkle
from metricloom.llm.queries import op10_merkle

SCHEMA = "doc_id long, text string, part int, k string"


def brute(rows):
    """(key, text) to the columns that a loop can tell."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for i, (k, t) in enumerate(order):
        t, y = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + y[:h]
        a, b, c = (merkle.Print(x.encode()) for x in (t, edited, y))
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), merkle.likeness(a.root, a.least, b.root, b.least), merkle.likeness(a.root, a.least, c.root, c.least)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def results(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_query_against_a_loop(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert results(op10_merkle(spark, sf_dir)) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, "a b"), (5, "a b"), (5, "c\nd"), (None, "x"), (None, None), (7, ""), (-3, "long é " * 4000), (2**53 + 1, "z"), (2**53, "y" * 7)]
    frame = lambda r: spark.createDataFrame([(*x, 1, "q") for x in r], SCHEMA)
    assert results(merkle.beside_next(frame(rows))) == brute(rows)
    assert results(merkle.beside_next(frame(rows[:1]))) == brute(rows[:1])
    assert merkle.beside_next(frame([])).collect() == []
    assert merkle.fingerprints(frame(rows)).count() == len(rows)


def test_equality_and_located_edits(spark):
    text = "\n\n".join("\n".join(f"paragraph {s} {p} of some words" for p in range(4)) for s in range(5)).encode()
    a = merkle.tree(text)
    changed = text.replace(b"paragraph 2 3 of", b"paragraph 2 3 was")
    s, e = merkle.edited_range(a, merkle.tree(changed))
    assert text[s:e] == b"paragraph 2 3 of some words"
    assert merkle.edited_range(a, merkle.tree(text)) is None
    for new in (b"", b"x\n\n" + text, text[:100], text + b"\n\nend", text.replace(b"paragraph 1 1 of some words\n", b"")):
        s, e = merkle.edited_range(a, merkle.tree(new))
        assert 0 <= s <= e <= len(text)
        assert new.startswith(text[: min(s, len(new))][: max(0, s - 2)])
    p, q = merkle.Print(text), merkle.Print(changed)
    assert 0.8 < merkle.likeness(p.root, p.least, q.root, q.least) < 1
    assert merkle.parse(str(p))[0] == p.root and (merkle.parse(str(p))[1] == p.least).all()
    row = merkle.edits(spark.createDataFrame([(1, text.decode(), changed.decode()), (2, None, "")], "doc_id long, a string, b string"), "a", "b").collect()
    assert [(r.equal, r.near == 1.0) for r in sorted(row, key=lambda r: r.doc_id)] == [(False, False), (True, True)]
