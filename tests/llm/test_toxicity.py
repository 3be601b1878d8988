"""The field against sums over all labellings, and held-out accuracy."""

import itertools
import math
import pickle

import numpy as np
import pytest

from metricloom.llm import toxicity as tox
from metricloom.llm.queries import op8_toxicity


def enumerated(emission, steps):
    """Log of the sum over all labellings of one document, and the share of those with each word toxic."""
    step = {(0, 0): 0.0, (0, 1): steps[1], (1, 0): steps[2], (1, 1): steps[3]}
    total, toxic = 0.0, np.zeros(len(emission))
    for y in itertools.product((0, 1), repeat=len(emission)):
        s = math.exp(sum(e * v for e, v in zip(emission, y, strict=True)) + sum(step[a, b] for a, b in zip((0, *y), y, strict=False)))
        total += s
        toxic += s * np.array(y)
    return math.log(total), toxic / total


def test_marginals_and_log_z_by_enumeration():
    rng = np.random.default_rng(1)
    sizes, steps = np.array([0, 7, 1, 0, 9, 2, 0]), np.array([-0.3, -0.4, 0.3, 0.6])
    emission = rng.normal(size=sizes.sum())
    chain = tox.Chain(emission, sizes, steps)
    parts = [enumerated(e, steps) for e in np.split(emission, np.cumsum(sizes)[:-1]) if len(e)]
    assert chain.log_z() == pytest.approx(sum(z for z, _ in parts))
    assert chain.marginal == pytest.approx(np.concatenate([p for _, p in parts]))


def test_slopes_by_differences():
    rng = np.random.default_rng(2)
    sizes, steps = np.array([6, 0, 1, 8]), np.array([-0.5, -0.2, 0.1, 0.4])
    words = tox.Words()
    ids, found = words(["Bad words here and BAD there", "", "one", "a b c d bad and good c"])
    assert (found == sizes).all()
    gold, weights = rng.integers(0, 2, len(ids)), rng.normal(size=tox.BUCKETS + 1) / 4
    weights[tox.BUCKETS] = 0
    value, slope, by_step = tox.likelihood(ids, sizes, gold, words.buckets, weights, steps)
    assert value > 0
    for at in rng.choice(np.unique(words.buckets[words.buckets < tox.BUCKETS]), 12, replace=False):
        d = np.zeros(tox.BUCKETS + 1)
        d[at] = 1e-5
        up, down = (tox.likelihood(ids, sizes, gold, words.buckets, weights + s * d, steps)[0] for s in (1, -1))
        assert slope[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)
    for i in range(4):
        d = np.eye(4)[i] * 1e-5
        up, down = (tox.likelihood(ids, sizes, gold, words.buckets, weights, steps + s * d)[0] for s in (1, -1))
        assert by_step[i] == pytest.approx((up - down) / 2e-5, abs=1e-5)


@pytest.fixture(scope="module")
def tables(spark):
    def rows(i):
        words = [f"word{(i * 7 + k * k) % 97}" for k in range(30)]
        if i % 3 == 0:
            words[i % 30] = ["slurry", "badness", "meanone"][i // 3 % 3] + ("s" if i % 2 else "")
        return (i, " ".join(words), "en", "x", float(i))

    docs = spark.createDataFrame([*map(rows, range(300)), (300, None, None, None, None), (301, "", "", "", 0.0), (None, "slurry", "en", "x", 1.0), (5, "word1", "en", "x", 1.0), (302, "slurry and " * 9000, "", "", 1.0)], "doc_id long, text string, lang string, label string, score double")
    labels = spark.createDataFrame([*((i, 0, int(i % 3 == 0)) for i in range(300)), (None, 0, 1), (4, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_learns_words_and_beginnings(tables):
    docs, labels = tables
    model = pickle.loads(pickle.dumps(tox.fit(docs, labels)))
    got = {r.doc_id: r for r in tox.score(docs, model).collect()}
    assert tox.score(docs, model).count() == docs.count()
    assert [(i, got[i].score, model) for i in range(300) if i != 5 and got[i].predicted != (i % 3 == 0)] == []
    assert got[None].predicted == 1 and got[302].predicted == 1
    assert got[300].score == got[301].score and got[300].predicted == 0
    span = got[9].spans[0]
    assert docs.where("doc_id = 9").first().text[span.start : span.end].startswith(("slurry", "badness", "meanone"))
    kept = tox.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in tox.score(docs, model).collect())


def test_neighbours_tell_words_apart(spark):
    """Words that are toxic side by side, among words that all documents have."""
    rows = [(i, " ".join([f"w{i % 13}x", "you", "frog" if i % 2 else "pond", "filth" if i % 2 else "green", f"w{i % 7}y"]), int(i % 2)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tox.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    scores, spans = model.score(["you frog filth", "w1x you pond green", ""])
    assert scores[0] > 0.5 > scores[1] and spans[0] and not spans[1] and scores[2] < 0.5


def test_odd_tables(spark, tables):
    docs, labels = tables
    for d, lab in ((docs, labels.limit(0)), (docs.limit(0), labels), (docs, labels.where("toxic = 1"))):
        assert tox.score(d, tox.fit(d, lab)).count() == d.count()
    assert tox.keep_clean(docs, tox.fit(docs, labels.limit(0))).count() == docs.count()
    named = docs.selectExpr("doc_id AS k", "text AS label", "label AS text")
    same = tox.fit(named, labels.withColumnRenamed("doc_id", "k"), "k", "label")
    assert {r.k: r.predicted for r in tox.score(named, same, "k", "label").collect()}[None] == 1


def test_query_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    got = op8_toxicity(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)


def plain_score(model, text):
    """One document's score by loops over its words: forward and backward sums in logarithms, then the calibration."""
    words = tox.WORD.findall(text)
    buckets = [tox.buckets_of(w) for w in words]
    weight = lambda b: float(model.weights[b])
    clip = lambda x: max(-30.0, min(30.0, x))
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    bias, enter, leave, stay = (float(model.steps[0]), *(clip(float(s)) for s in model.steps[1:]))
    e = []
    for i, own in enumerate(buckets):
        x = bias + sum(map(weight, own[: tox.OWN]))
        x += weight(buckets[i - 1][tox.OWN]) if i else 0.0
        x += weight(buckets[i + 1][tox.OWN + 1]) if i + 1 < len(buckets) else 0.0
        e.append(clip(x))
    ahead, behind = [], [(0.0, 0.0)]
    for i, x in enumerate(e):
        c, t = ahead[-1] if i else (0.0, -1e9)
        ahead.append((add(c, t + leave), add(c + enter, t + stay) + x))
    for x in e[:0:-1]:
        c, t = behind[-1]
        behind.append((add(c, t + enter + x), add(c + leave, t + stay + x)))
    p = [1 / (1 + math.exp(clip(c + a - t - b))) for (c, t), (a, b) in zip(ahead, reversed(behind), strict=True)] if words else []
    top = min(max(max(p, default=1e-6), 1e-6), 1 - 1e-6)
    x = model.calibration @ np.array([1.0, math.log(top / (1 - top)), math.log1p(sum(p))])
    return 1 / (1 + math.exp(-clip(float(x))))


def test_query_against_a_plain_field(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.score for r in op8_toxicity(spark, sf_dir).collect()}
    model = tox.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    wanted = {r.doc_id: plain_score(model, r.text or "") for r in docs.collect()}
    assert set(got) == set(wanted)
    assert max(abs(got[k] - wanted[k]) for k in got) < 0.01  # the query's fit sums in an order of its own
    exact = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    assert max(abs(exact[k] - wanted[k]) for k in exact) < 1e-6
