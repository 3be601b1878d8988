"""The audit of sources against plain counts with Python's integers, also with digests that many terms share."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from metricloom.llm import divergence
from metricloom.llm.queries import op12_divergence

SCHEMA = "text string, lang string, source string, doc_id long, no int, value string, rank int, digest string"


def brute(rows, least=3, ranks=200):
    """Rows of the result from (text, lang, source)."""
    documents, counts = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
        groups[lang].add(source)
        documents[lang].update(terms.keys())
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, whole: 1 + 1_000_000_000 * (n + 1) // (whole + len(kept))  # noqa: B023, E731
        p = {s: [share(counts[lang, s][t], total[s]) for t in kept] for s in sources}
        q = [share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept]
        for s in sources:
            pairs = [(o, sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True))) for o in sources if o != s]
            terms = [(t, (a - b) ** 2 // b) for t, a, b in zip(kept, p[s], q, strict=True) if counts[lang, s][t] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ordered)]
    return sorted(out)


def results(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, i, 1, "v", 2, "d") for i, r in enumerate(rows)], SCHEMA)


ODD = [
    ("the cat the dog", "en", "a"), ("The Cat sat", "en", "b"), ("the cat is é straße", "en", None), (None, "en", "c"), ("", "en", "d"), ("é straße é", "en", "a"), ("straße é x1y2z", "en", "b"),
    ("the cat the dog", "en", "a"), ("the cat the dog", "en", "a"), ("only one", None, None), ("x", "fr", "a"), ("y", "fr", "b"), ("日本 語 日本", "ja", "é"), ("日本 語", "ja", "z"), ("日本", "ja", ""),
    ("long " * 20_000 + "word " * 7, "en", "b"), ("x" * 50_000, "en", "a"), ("123 ?!", "en", "a"),
]


def test_query_against_plain_counts(spark, sf_dir):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert results(op12_divergence(spark, sf_dir)) == brute(rows)


def test_odd_rows(spark):
    assert results(divergence.audit(frame(spark, ODD).repartition(3))) == brute(ODD)
    assert results(divergence.audit(frame(spark, ODD[9:12]))) == brute(ODD[9:12])  # no kept terms: pairs only
    assert divergence.audit(frame(spark, [])).collect() == []


def test_shared_digests_change_no_row(spark, monkeypatch):
    rows = ODD + [(f"w{chr(97 + i % 26)}{chr(97 + i // 26)} common", "en", "abc"[i % 3]) for i in range(200) for _ in range(1 + i % 4)]
    table = divergence.counted(frame(spark, rows), divergence.numbered_sources(frame(spark, rows)), 5)
    assert divergence.kept_terms(table)[1].count() > 100
    assert results(divergence.audit(frame(spark, rows).repartition(4), bits=5)) == brute(rows)
    assert results(divergence.audit(frame(spark, rows), ranks=5)) == brute(rows, ranks=5)  # most ranks tie


def test_small_pieces_and_matrices(monkeypatch):
    rows = [((a or "").encode(), b or "", c or "") for a, b, c in ODD]
    numbers = {x: i for i, x in enumerate(sorted({r[2] for r in rows}))}

    def counted():
        counter = divergence.Counter()
        counter.add([r[0] for r in rows], [r[1] for r in rows], [numbers[r[2]] for r in rows])
        return sorted(zip(*(x.to_pylist() for x in counter.rows().columns), strict=True))

    whole = counted()
    monkeypatch.setattr(divergence, "PIECE_BYTES", 7)
    assert counted() == whole


def test_long_division_is_exact():
    rng = np.random.default_rng(1)
    totals = rng.integers(1, 8 * 10**15, 1000)
    counts = (totals * rng.random(1000)).astype(np.int64)
    assert [int(x) for x in divergence.shares(counts, totals)] == [1 + 10**9 * int(c) // int(t) for c, t in zip(counts, totals, strict=True)]


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_pieces_end_between_terms(step):
    data = np.frombuffer(b"ab cde  f\nlonglonglong x", np.uint8)
    got = list(divergence.pieces(data, step))
    assert [s for s, _ in got] == [0, *(e for _, e in got[:-1])] and got[-1][1] == len(data)
    assert all(e == len(data) or not divergence.IN_TERM[data[e - 1]] for _, e in got)
