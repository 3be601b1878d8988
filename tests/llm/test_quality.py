"""Site effects against plain sums, and held-out accuracy."""

import math

import pytest
from pyspark.sql import functions as F

from metricloom.llm import quality
from metricloom.llm.queries import op9_quality


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = [], []
    for i in range(600):
        host = f"h{i % 4}"
        junk = i % 5 == 0
        text = " | ".join(f"w{i}{k} ### $$" for k in range(20)) if junk else f"This is text number {i}, and it reads well. It goes on."
        rows.append((i, text, host, "p" + str(i % 2), 0.5, True))
        labels.append((i, int(not junk and not (host == "h3" and i % 3)), 0))
    rows += [(900, None, None, None, None, None), (901, "", "", "", 0.1, False), (None, "One more text.", "h1", "p0", 0.2, True), (3, rows[3][1], "h3", "p1", 0.5, True), (902, "word " * 20000, "new", "p", 0.5, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, host string, path string, score double, keep boolean"), spark.createDataFrame([*labels, (None, 1, 1), (902, None, None)], "doc_id long, quality int, toxic int")


def test_sites_move_scores(tables):
    docs, labels = tables
    got = quality.score(docs, labels, "host", "path").collect()
    assert len(got) == docs.count() and all(0 < r.score < 1 and r.keep == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3].host_effect < -0.5 < 0 < by[1].host_effect
    assert by[902].host_effect == by[902].path_effect == 0 and by[902].score == pytest.approx(by[902].p_document)
    assert by[0].keep is False and by[1].keep is True
    odds = lambda p: math.log(p / (1 - p))
    assert all(odds(r.score) == pytest.approx(odds(r.p_document) + r.host_effect + r.path_effect) for r in got)


def test_host_effect_by_hand(spark, tables):
    docs, labels = tables
    from zlib import crc32

    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None and crc32(str(r.doc_id).encode()) % 5}
    host = [(d.doc_id, d.host) for d in docs.collect()]
    got = {}
    for r in quality.score(docs, labels, "host", "path").collect():
        got.setdefault(r.doc_id, r)
    sums = {}
    for k, h in host:
        if k in y:
            p = got[k].p_document
            n = sums.setdefault(h, [0, 0, 0.0, 0.0])
            for i, v in enumerate((1, y[k], p, p * (1 - p))):
                n[i] += v
    spread = max(0, (sum((s[1] - s[2]) ** 2 for s in sums.values()) - sum(s[3] for s in sums.values())) / sum(s[0] ** 2 for s in sums.values()))
    mean = sum(s[1] for s in sums.values()) / sum(s[0] for s in sums.values())
    strength = mean * (1 - mean) / spread
    n, ys, p, _ = sums["h3"]
    t = (ys + strength * p / n) / (n + strength)
    assert got[7].host_effect == pytest.approx(math.log(t / (1 - t)) - math.log(p / n / (1 - p / n)))


def test_sites_of_urls(spark):
    urls = {"https://www.Example.org:80/blog/2020/x.html?q=/a/b": ("example.org", "blog"), "http://u:p@h.net/page": ("h.net", ""), "ftp://h.net": ("h.net", ""), "no url/at/all": ("", ""), None: ("", ""), "https://a.b/c/d/#/e": ("a.b", "c")}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = df.select("url", *(c.alias(n) for c, n in zip(quality.site_of(F.col("url")), "hp", strict=True))).collect()
    assert {r.url: (r.h, r.p) for r in got} == urls
    assert df.where("url like '%blog%'").select(quality.site_of(F.col("url"), 2)[1]).first()[0] == "blog/2020"


def test_query_against_plain_sums(spark, sf_dir):
    """Scores of the query from its own document probabilities, by sums over hosts and paths in Python."""
    from zlib import crc32

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang").collect()}
    y = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        if crc32(str(r.doc_id).encode()) % 5:
            y[r.doc_id] = max(r.quality, y.get(r.doc_id, 0))
    rows = {r.doc_id: r for r in op9_quality(spark, sf_dir).collect()}
    odds = lambda p: math.log(p / (1 - p))

    def strength(sites):
        n, ys = sum(s[0] for s in sites), sum(s[1] for s in sites)
        spread = max(0.0, (sum((s[1] - s[2]) ** 2 for s in sites) - sum(s[3] for s in sites)) / sum(s[0] ** 2 for s in sites))
        mean = min(max(ys / n, 1e-3), 1 - 1e-3)
        return min(quality.MAX_STRENGTH, mean * (1 - mean) / spread) if spread else quality.MAX_STRENGTH

    hosts, paths = {}, {}
    for k, v in y.items():
        d, p = docs[k], rows[k].p_document
        for sites, at in ((hosts, d.source), (paths, (d.source, d.lang))):
            s = sites.setdefault(at, [0, 0, 0.0, 0.0])
            for i, x in enumerate((1, v, p, p * (1 - p))):
                s[i] += x
    effect = lambda s, m, e: odds((s[1] + m * e) / (s[0] + m)) - odds(e)
    own = {h: effect(s, strength(hosts.values()), s[2] / s[0]) for h, s in hosts.items()}
    moved = {at: 1 / (1 + math.exp(-(odds(s[2] / s[0]) + own[at[0]]))) for at, s in paths.items()}
    m = strength([(s[0], s[1], moved[at] * s[0], s[3]) for at, s in paths.items()])
    for k, r in rows.items():
        at = (docs[k].source, docs[k].lang)
        host, path = own.get(at[0], 0.0), effect(paths[at], m, moved[at]) if at in paths else 0.0
        assert (r.host_effect, r.path_effect) == (pytest.approx(host, abs=1e-6), pytest.approx(path, abs=1e-6))
        assert odds(r.score) == pytest.approx(odds(r.p_document) + host + path, abs=1e-6) and r.predicted == (r.score >= 0.5)


def test_odd_tables(spark, tables):
    docs, labels = tables
    assert {r.score for r in quality.score(docs, labels.limit(0), "host", "path").collect()} == {0.5}
    assert quality.score(docs.limit(0), labels, "host", "path").collect() == []


def test_query_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    rows = op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.85 * len(rows)
