"""Registered queries that SQL cannot express, over whole tables, against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest

from metricloom import queries

from conftest import SF


def area(b):
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(0, w) * max(0, h)
    return common / (area(a) + area(b) - common) if common else 0.0


def matched(truth, found, iou, within=lambda b: True):
    """(label, score) of one image: detections, best first, take the free box they overlap most, the later of equal ones."""
    free, rows = list(range(len(truth))), []
    for d in sorted(found, key=lambda d: -d[5]):
        best = max(((overlap(d, truth[j]), j) for j in free if overlap(d, truth[j]) >= iou), default=None)
        if best:
            free.remove(best[1])
            if within(truth[best[1]]):
                rows.append((1, d[5]))
        elif within(d):
            rows.append((0, d[5]))
    return rows + [(1, 0.0) for j in free if within(truth[j])]


@pytest.fixture(scope="module")
def images(spark):
    return [(r.truth, r.found) for r in queries.images(spark, SF).collect()]


def ratio(a, b):
    return round(a / b, 6) if b else None


def test_detection_at_threshold(spark, images):
    rows = [x for t, f in images for x in matched(t, f, 0.5, lambda b: 400 <= area(b) <= 2500)]
    want = {}
    for t in (0.3, 0.6):
        tp, fp, fn = (sum(1 for y, p in rows if c(y, p)) for c in (lambda y, p: y and p > t, lambda y, p: not y and p > t, lambda y, p: y and p <= t))  # noqa: B023
        want[t] = (ratio(tp, tp + fp), ratio(tp, tp + fn))
    assert {r.threshold: (r.precision, r.recall) for r in queries.detection_at_threshold(spark, SF).collect()} == want


def test_detection_under_constraints(spark, images):
    rows = [x for t, f in images for x in matched(t, f, 0.5)]
    bucket = lambda p: math.floor(p * 10_000) / 10_000
    points = []
    for t in [1e-12, *(i / 100 for i in range(1, 101))]:
        tp, fp, fn = (sum(1 for y, p in rows if c(y, bucket(p) + 1e-12 >= t)) for c in (lambda y, up: y and up, lambda y, up: not y and up, lambda y, up: y and not up))
        points.append((t, tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn)))
    most = sum(1 for y, p in rows if y and p > 1e-12) / sum(y for y, _ in rows)
    want = {"PrecisionAtRecall": max((p for _, p, r in points if r >= 0.4), default=0), "ThresholdAtRecall": max((t for t, _, r in points if r >= 0.4), default=0), "RecallAtPrecision": max((r for _, p, r in points if p >= 0.5), default=0), "MaxRecall": most}
    assert {r.metric: r.value for r in queries.detection_under_constraints(spark, SF).collect()} == {k: round(v, 6) for k, v in want.items()}


def test_object_detection(spark, images):
    got = {(r.class_id, round(r.iou, 2)): (r.average_precision, r.average_recall) for r in queries.object_detection(spark, SF).collect()}
    assert len(got) == 20
    for kind in (0, 1):
        for iou in (0.5, 0.75, 0.9):
            exact = 0.5 + 0.05 * round((iou - 0.5) / 0.05)
            rows = [x for t, f in images for x in matched([b for b in t if b[4] == kind], [d for d in f if d[4] == kind], exact)]
            total, steps = sum(y for y, _ in rows), defaultdict(lambda: [0, 0])
            for y, p in rows:
                if p > 0:
                    steps[math.floor(p * 10_000)][1 - y] += 1
            tp = fp = 0
            curve = []
            for s in sorted(steps, reverse=True):
                tp, fp = tp + steps[s][0], fp + steps[s][1]
                curve.append((tp / total, tp / (tp + fp)))
            precision = sum(max((p for r, p in curve if r >= i / 100), default=0.0) for i in range(101)) / 101
            assert got[kind, iou] == (pytest.approx(precision, abs=2e-6), pytest.approx(max(r for r, _ in curve), abs=2e-6))


@pytest.fixture(scope="module")
def answers(spark):
    return [(r.turn, r.hypothesis or "", [x or "" for x in r.references]) for r in queries.answers(spark, SF).collect()]


def split(text):
    """Punctuation alone, but for full stops and commas within numbers."""
    text = re.sub(r"([{-~\[-` -&(-+:-@/])", r" \1 ", f" {text.replace(chr(10), ' ')} ")
    text = re.sub(r"([^0-9])([.,])", r"\1 \2 ", text)
    text = re.sub(r"([.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def test_bleu(spark, answers):
    slices = defaultdict(list)
    for turn, h, refs in answers:
        for name in ("Overall", f"turn:{turn}"):
            slices[name].append((split(h), [split(x) for x in refs]))
    got = {r.slice: r for r in queries.bleu(spark, SF).collect()}
    assert set(got) == set(slices)
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for name, pairs in slices.items():
        own = sum(len(h) for h, _ in pairs)
        other = sum(min((len(x) for x in refs), key=lambda s: (abs(s - len(h)), s)) for h, refs in pairs)  # noqa: B023
        logs, empty = 0.0, 0
        for n in range(1, 5):
            match = sum(min(c, max(grams(x, n)[g] for x in refs)) for h, refs in pairs for g, c in grams(h, n).items())
            total = sum(max(0, len(h) - n + 1) for h, _ in pairs)
            if total and not match:
                empty += 1
            p = 100 * match / total if match else 100 / (2**empty * total) if total else 0
            logs += math.log(p) if p else -math.inf
        brevity = 1.0 if own >= other else math.exp(1 - other / own) if own else 0.0
        assert got[name].value == pytest.approx(brevity * math.exp(logs / 4), abs=2e-6)
        assert (got[name].hypothesis_length, got[name].reference_length) == (own, other)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rouge(spark, answers):
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    def score(h, r, kind):
        a, b = words(h), words(r)
        if kind == "rougeL":
            hit, x, y = common(a, b), len(a), len(b)
        else:
            p, q = grams(a, int(kind[-1])), grams(b, int(kind[-1]))
            hit, x, y = (p & q).total(), p.total(), q.total()
        precision, recall = hit / x if x else 0.0, hit / y if y else 0.0
        return precision, recall, 2 * precision * recall / (precision + recall) if hit else 0.0

    got = {r.kind: (r.precision, r.recall, r.fmeasure) for r in queries.rouge(spark, SF).collect()}
    for kind in ("rouge1", "rouge2", "rougeL"):
        best = [max((score(h, x, kind) for x in refs), key=lambda s: s[2]) for _, h, refs in answers]
        assert got[kind] == tuple(pytest.approx(sum(s[i] for s in best) / len(best), abs=2e-6) for i in range(3))
