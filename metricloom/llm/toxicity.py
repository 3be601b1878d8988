"""Toxic spans by a linear-chain conditional random field.

A document's words are a chain of two states, clean and toxic. A word's log-potential of the toxic state is the sum of the
weights of its features: the word, its beginnings, its ending, its shape and the words beside it, each hashed into one of
a fixed number of buckets; steps between states have weights of their own. The field is fitted by conditional likelihood
on labelled words: in toxic documents those whose buckets toxic documents hold far more often than clean ones are toxic,
all others clean. Tasks run the forward and backward passes and sum likelihood and gradients, the driver takes the steps.

Both passes are products of two-by-two matrices. They are taken over the words of many documents at once, pairs first,
then pairs of pairs, so long documents cost no more a word than short ones. The marginals make the document's score and
mark the offending places.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import checkpointed, discard, fold, map_batches, slices_of

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows of each class that the model is fitted on at most, taken in the order of a hash of their key.
SAMPLE_ROWS = 10_000
#: Buckets of hashed features; one more stands for a feature that a word does not have.
BUCKETS = 1 << 18
#: Beginnings of a word, in characters.
BEGINNINGS = (4, 5, 6)
#: Columns of a word's buckets: the word and its beginnings, which may label it; then ending and shape; then as a neighbour.
LABELLING, OWN = 1 + len(BEGINNINGS), 3 + len(BEGINNINGS)
MIN_TOXIC_DOCUMENTS, MIN_LOG_ODDS, MIN_DEVIATION = 5, 2.0, 4.0
#: Words that a task remembers, and documents whose words are one chain of matrices.
KEPT_WORDS, ROWS = 200_000, 200
#: Weights of the steps: into the toxic state for any word, from clean to toxic, from toxic to clean and within toxic.
STEPS = ("bias", "enter", "leave", "stay")
START = np.array([-6.0, -1.0, -1.0, 0.0])
#: Where the fit starts: the weight of a bucket that labels words. Then steps at most, and the penalty on squares.
LIKELY, ROUNDS, PENALTY = 6.0, 40, 1.0


def buckets_of(word: str) -> tuple[int, ...]:
    """Buckets of a word's own features, and those that it gives the word to its right and to its left."""
    from xxhash import xxh3_64_intdigest as digest

    low = word.lower()
    shape = ("A" if word.isupper() and len(word) > 1 else "T" if word[0].isupper() else "a") + str(min(len(low), 9))
    names = ["w" + low, *("b" + low[:n] if len(low) >= n else "" for n in BEGINNINGS), "e" + low[-3:], "s" + shape, "l" + low, "r" + low]
    return tuple(digest(x) % BUCKETS if x else BUCKETS for x in names)


class Numbers(dict):
    """A number for each word, by first appearance."""

    def __missing__(self, x: str) -> int:
        n = self[x] = len(self)
        return n


class Words:
    """Words as numbers, and the buckets of each."""

    def __init__(self) -> None:
        self.numbers, self.buckets = Numbers(), np.zeros((0, OWN + 2), np.int32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts in a row, and how many each text has."""
        if len(self.numbers) > KEPT_WORDS:
            self.__init__()
        known, have = self.numbers.__getitem__, len(self.buckets)
        found = [np.fromiter(map(known, WORD.findall(x)), np.int32) for x in texts]
        if len(self.numbers) > have:
            new = list(self.numbers)[have:]
            self.buckets = np.concatenate((self.buckets, np.array([buckets_of(x) for x in new], np.int32)))
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.fromiter(map(len, found), np.int64, len(found))


def _times(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Products of two-by-two matrices, each scaled to a sum of one."""
    out = [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]]
    scale = 1 / (out[0] + out[1] + out[2] + out[3])
    return [x * scale for x in out]


def products(m: list[np.ndarray]) -> list[np.ndarray]:
    """Scaled products of all matrices up to each place: those of pairs give every other one."""
    n = len(m[0])
    if n < 2:
        return m
    even = n // 2 * 2
    half = products(_times([x[:even:2] for x in m], [x[1:even:2] for x in m]))
    between = _times([x[: (n - 1) // 2] for x in half], [x[2::2] for x in m])
    out = [np.empty(n) for _ in m]
    for o, h, b, x in zip(out, half, between, m, strict=True):
        o[1::2], o[2::2], o[0] = h, b, x[0]
    return out


class Chain:
    """Passes over the words of many documents, given the log-potential of the toxic state at each word."""

    def __init__(self, emission: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> None:
        _, enter, leave, stay = np.exp(np.clip(steps, -30, 30))
        toxic = np.exp(np.clip(emission, -30, 30))
        self.steps, self.toxic, n = (enter, leave, stay), toxic, len(emission)
        ends = np.cumsum(sizes)
        self.first = np.zeros(n, bool)
        self.first[(ends - sizes)[sizes > 0]] = True
        # a clean word stands before each document: whatever came before it, the first step is from there
        low = np.where(self.first, 1.0, leave)
        m = [np.ones(n), enter * toxic, low, np.where(self.first, enter, stay) * toxic]
        ahead = products(m)
        a0, a1 = ahead[0] + ahead[2], ahead[1] + ahead[3]
        self.alpha = a1 / (a0 + a1)
        back = products([m[0][::-1], m[2][::-1], m[1][::-1], m[3][::-1]])  # transposed, from the end
        b0, b1 = (back[0] + back[2])[::-1], (back[1] + back[3])[::-1]
        self.beta = np.full(n, 0.5)
        if n > 1:
            self.beta[:-1] = (b1 / (b0 + b1))[1:]
        both = self.alpha * self.beta
        self.marginal = both / (both + (1 - self.alpha) * (1 - self.beta))

    def before(self) -> np.ndarray:
        """Probability of the toxic state at the word before, given the words up to there."""
        out = np.concatenate(([0.0], self.alpha[:-1]))
        out[self.first] = 0.0
        return out

    def log_z(self) -> float:
        """Sum of the documents' logarithms of all labellings' potentials."""
        (enter, leave, stay), p = self.steps, self.before()
        return float(np.log((1 - p) * (1 + enter * self.toxic) + p * (leave + stay * self.toxic)).sum())

    def step_counts(self) -> np.ndarray:
        """Expected numbers of toxic words and of each kind of step."""
        (enter, leave, stay), p = self.steps, self.before()
        b0, b1 = 1 - self.beta, self.beta
        parts = [(1 - p) * b0, (1 - p) * enter * self.toxic * b1, p * leave * b0, p * stay * self.toxic * b1]
        total = parts[0] + parts[1] + parts[2] + parts[3]
        return np.array([self.marginal.sum(), *((x / total).sum() for x in parts[1:])])


def emissions(ids: np.ndarray, sizes: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, bias: float) -> np.ndarray:
    """Log-potentials from each word's own weight and from those of its neighbours in the document."""
    out = own[ids] + bias
    if len(ids) > 1:
        inner = np.ones(len(ids) - 1, bool)
        ends = np.cumsum(sizes)[:-1]
        inner[ends[(ends > 0) & (ends < len(ids))] - 1] = False  # no neighbours across documents
        out[1:] += np.where(inner, left[ids[:-1]], 0.0)
        out[:-1] += np.where(inner, right[ids[1:]], 0.0)
    return out


def likelihood(ids: np.ndarray, sizes: np.ndarray, gold: np.ndarray, buckets: np.ndarray, weights: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the labels, its slope by buckets, and by steps."""
    own, left, right = weights[buckets[:, :OWN]].sum(1), weights[buckets[:, OWN]], weights[buckets[:, OWN + 1]]
    emission = emissions(ids, sizes, own, left, right, steps[0])
    chain = Chain(emission, sizes, steps)
    last = np.concatenate(([0], gold[:-1]))
    last[chain.first] = 0
    seen = np.array([gold.sum(), ((last == 0) & (gold == 1)).sum(), ((last == 1) & (gold == 0)).sum(), ((last == 1) & (gold == 1)).sum()], float)
    value = chain.log_z() - float((np.clip(emission, -30, 30) * gold).sum()) - float((steps[1:] * seen[1:]).sum())
    gap = chain.marginal - gold
    inner = ~chain.first[1:]
    n = len(buckets)
    by_word = [np.bincount(ids, gap, n), np.bincount(ids[:-1], np.where(inner, gap[1:], 0.0), n), np.bincount(ids[1:], np.where(inner, gap[:-1], 0.0), n)]
    slope = np.bincount(buckets[:, :OWN].ravel(), np.repeat(by_word[0], OWN), BUCKETS + 1)
    slope += np.bincount(buckets[:, OWN], by_word[1], BUCKETS + 1) + np.bincount(buckets[:, OWN + 1], by_word[2], BUCKETS + 1)
    slope[BUCKETS] = 0.0
    return value, slope, chain.step_counts() - seen


@dataclass
class Model:
    """``weights`` by bucket, those of ``steps``, and how evidence becomes a probability."""

    weights: np.ndarray
    steps: np.ndarray
    calibration: np.ndarray
    words: Words | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "words": None}

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the toxic state at each word of all texts in a row, and how many words each has."""
        if self.words is None:
            self.words = Words()
        ids, sizes = self.words(texts)
        if not len(ids):
            return np.zeros(0), sizes
        w, b = self.weights, self.words.buckets
        some, at = np.unique(ids, return_inverse=True)
        own, left, right = w[b[some, :OWN]].sum(1), w[b[some, OWN]], w[b[some, OWN + 1]]
        return Chain(emissions(at, sizes, own, left, right, self.steps[0]), sizes, self.steps).marginal, sizes

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text what the marginals say about it: one, the greatest one's log-odds, and how many words they make."""
        p, sizes = self.marginals(texts)
        top, total = np.full(len(sizes), 1e-6), np.zeros(len(sizes))
        some = sizes > 0
        if some.any():
            starts = (np.cumsum(sizes) - sizes)[some]
            top[some], total[some] = np.maximum.reduceat(p, starts), np.add.reduceat(p, starts)
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.stack((np.ones(len(sizes)), np.log(top / (1 - top)), np.log1p(total)), 1), p, sizes

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Each text's probability, and start, end and probability of its offending words, in code points."""
        x, p, sizes = self.evidence(texts)
        hit, ends, spans = p >= 0.5, np.cumsum(sizes), []
        for text, s, e in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
            own = hit[s:e]
            spans.append([(*m.span(), float(q)) for m, h, q in zip(WORD.finditer(text), own.tolist(), p[s:e].tolist(), strict=True) if h] if own.any() else [])
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30))), spans


def _labelling(sample: DataFrame, counts: dict[int, int]) -> np.ndarray:
    """Whether a word with a bucket is toxic in toxic documents: by the documents of either class that hold the bucket."""

    def count(batch: pa.RecordBatch) -> dict:
        words, seen = Words(), np.zeros((2, BUCKETS + 1), np.int64)
        labels = batch.column("label").to_pylist()
        for s in range(0, len(labels), ROWS):
            ids, sizes = words([x or "" for x in batch.column("text").slice(s, ROWS).to_pylist()])
            for y, own in zip(labels[s : s + ROWS], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                seen[y][np.unique(words.buckets[np.unique(own), :LABELLING])] += 1
        seen[:, BUCKETS] = 0
        at = np.flatnonzero(seen.sum(0))
        return {"bucket": pa.array(at), "clean": pa.array(seen[0][at]), "toxic": pa.array(seen[1][at])}

    found = map_batches(sample, count, "bucket long, clean long, toxic long", 10_000).groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    bucket, clean, toxic = (found.column(c).to_numpy() for c in ("bucket", "clean", "toxic"))
    odds = np.log((toxic + 0.5) / (counts[1] + 1)) - np.log((clean + 0.5) / (counts[0] + 1))
    share = counts[1] / (counts[0] + counts[1])
    expected = (toxic + clean) * share
    out = np.zeros(BUCKETS + 1, bool)
    out[bucket] = (toxic >= MIN_TOXIC_DOCUMENTS) & (odds >= MIN_LOG_ODDS) & ((toxic - expected) / np.sqrt(expected * (1 - share)) >= MIN_DEVIATION)
    return out


def _labelled(sample: DataFrame, labelling: np.ndarray) -> DataFrame:
    """Documents as numbers of words, with the labels of the words and the words' buckets, some hundred to a row."""

    def run(batch: pa.RecordBatch) -> dict:
        words = Words()
        ids, sizes = words([x or "" for x in batch.column("text").to_pylist()])
        toxic = np.repeat(np.array(batch.column("label").to_pylist(), bool), sizes)
        gold = toxic & labelling[words.buckets[:, :LABELLING]].any(1)[ids]
        return {"sizes": [sizes.astype(np.int64).tobytes()], "ids": [ids.tobytes()], "gold": [gold.astype(np.int8).tobytes()], "buckets": [words.buckets.tobytes()]}

    return map_batches(sample, run, "sizes binary, ids binary, gold binary, buckets binary", ROWS)


def _loss(labelled: DataFrame, weights: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Likelihood and slopes over the sample: each task sums its documents, one row a task comes back."""
    import zstandard

    small = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, slope, by_step = 0.0, np.zeros(BUCKETS + 1), np.zeros(len(STEPS))
        for batch in slices_of(batches, 1):
            sizes, ids, gold, buckets = (np.frombuffer(batch.column(c)[0].as_py(), k) for c, k in (("sizes", np.int64), ("ids", np.int32), ("gold", np.int8), ("buckets", np.int32)))
            if len(ids):
                v, a, b = likelihood(ids, sizes, gold.astype(np.int64), buckets.reshape(-1, OWN + 2), small, steps)
                value, slope, by_step = value + v, slope + a, by_step + b
        packed = zstandard.ZstdCompressor(level=1).compress(slope.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_pydict({"value": [value], "slope": [packed], "steps": [by_step.tolist()]})

    value, slope, by_step = 0.0, np.zeros(BUCKETS + 1), np.zeros(len(STEPS))
    for r in labelled.mapInArrow(run, "value double, slope binary, steps array<double>").collect():
        value, by_step = value + r.value, by_step + np.array(r.steps)
        slope += np.frombuffer(zstandard.ZstdDecompressor().decompress(r.slope), np.float32)
    return value, slope, by_step


def _fitted(labelled: DataFrame, labelling: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights of buckets and steps: limited-memory BFGS on the likelihood with a penalty on squares."""
    start = np.concatenate((np.zeros(BUCKETS + 1), START))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope, by_step = _loss(labelled, x[: BUCKETS + 1], x[BUCKETS + 1 :])
        gone = x - start
        return value + penalty / 2 * float(gone @ gone), np.concatenate((slope, by_step)) + penalty * gone

    x, kept = start.copy(), []
    x[: BUCKETS + 1][labelling] = LIKELY
    value, g = loss(x)
    for _ in range(rounds):
        way, used = -g, []
        for s, y in reversed(kept):
            a = (s @ way) / (s @ y)
            used.append(a)
            way = way - a * y
        way = way * ((kept[-1][0] @ kept[-1][1]) / (kept[-1][1] @ kept[-1][1]) if kept else min(1.0, 1.0 / max(1e-9, np.linalg.norm(g))))
        for (s, y), a in zip(kept, reversed(used), strict=True):
            way = way + s * (a - (y @ way) / (s @ y))
        rate = 1.0
        while True:
            new, slope = loss(x + rate * way)
            if new <= value + 1e-4 * rate * (g @ way) or rate < 1e-3:
                break
            rate /= 4
        if not new < value:
            break
        step, turn = rate * way, slope - g
        if step @ turn > 1e-10:
            kept = [*kept[-7:], (step, turn)]
        x, g, last, value = x + step, slope, value, new
        if last - value < 1e-4 * abs(value):
            break
    return x[: BUCKETS + 1].astype(np.float32), x[BUCKETS + 1 :]


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the evidence by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-2 * b
        b = b + np.clip(np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 1e-2 * np.eye(len(b)), slope), -2, 2)
    return b


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled documents whose fold is not 0.

    At most ``sample_rows`` keys of each class are used, the first by a hash of the key, of equal hashes the lesser key;
    all words of their documents count. With several labels the larger counts, rows with a null key or label are left out,
    as are labels other than 0 and 1. With one class or none, the model scores every text with the share of toxic labels,
    smoothed, which without labels is a quarter. Columns may have any names; only the key, the text and the label are read.
    """
    k, y = F.col(f"`{key}`"), F.col(f"`{label}`")
    known = labels.where(y.isin(0, 1) & k.isNotNull()).groupBy(k.alias("k")).agg(F.max(y).cast("int").alias("label")).where(fold("k") != 0)
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("k").cast("string"))
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(order, "k").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = chosen.collect()  # at most twice ``sample_rows`` keys
    counts = {c: sum(r.label == c for r in rows) for c in (0, 1)}
    share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 2)
    plain = Model(np.zeros(BUCKETS + 1, np.float32), START, np.array([math.log(share / (1 - share)), 0.0, 0.0]))
    if not counts[0] or not counts[1]:
        return plain
    ids = docs.sparkSession.createDataFrame(rows, chosen.schema)
    sample = checkpointed(docs.select(k.alias("k"), F.col(f"`{text}`").alias("text")).join(F.broadcast(ids), "k").select("label", "text"))
    labelling = _labelling(sample, counts)
    labelled = checkpointed(_labelled(sample, labelling))
    model = Model(*_fitted(labelled, labelling), np.zeros(3))

    def judge(batch: pa.RecordBatch) -> dict:
        x = model.evidence([t or "" for t in batch.column("text").to_pylist()])[0]
        return {"label": batch.column("label"), "x": x.tolist()}

    found = map_batches(sample, judge, "label int, x array<double>", ROWS).collect()  # three figures for each sampled row
    discard(sample, labelled)
    if len({r.label for r in found}) < 2:
        return plain
    y = np.array([r.label for r in found], float)
    weight = np.array([totals[c] / max(1, counts[c]) for c in y.astype(int)])
    model.calibration = _calibrate(np.array([r.x for r in found]), y, weight)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted, spans`` for each row: spans are start, end and probability of offending words.

    A null text counts as empty and gets the score of a text without evidence. Other columns are not read, so no label,
    language or source can reach the score.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        scores, spans = model.score([x or "" for x in batch.column(text).to_pylist()])
        return {key: batch.column(key), "score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32)), "spans": [[{"start": a, "end": b, "p": p} for a, b, p in s] for s in spans]}

    return map_batches(docs.select(f"`{key}`", f"`{text}`"), run, f"`{key}` {kind}, score double, predicted int, spans array<struct<start: bigint, end: bigint, p: double>>", ROWS)


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns; null texts are clean unless the model says all are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, ROWS):
            yield batch.filter(pa.array(model.score([x or "" for x in batch.column(text).to_pylist()])[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
