"""Quality by hierarchical empirical Bayes over documents, hosts and paths.

A logistic classifier on how a text looks gives each document's evidence. For each host, labels of training documents are
compared with what the classifier expects of them; a beta prior around that expectation, with a strength estimated from
all hosts by moments, shrinks hosts with few labels to no effect. Paths shrink in the same way towards their host. The
effects move the documents' log-odds. All site figures are grouped sums, partly summed before they move.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import checkpointed, fold, map_batches

#: Labelled documents that the classifier is fitted on at most, the first by a hash of their key.
SAMPLE_ROWS = 20_000
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")
#: No site can be surer than so many labels of its own.
MAX_STRENGTH = 1e6


def looks(text: str) -> list[float]:
    """Figures of the whole text that a reader would notice."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    letters = sum(map(str.isalpha, text)) if chars < 200 else len(re.sub(r"[\W\d_]+", "", text))
    distinct = len(set(words))
    return [
        math.log1p(len(words)),
        chars / n,
        letters / chars,
        len(SYMBOL.findall(text)) / n,
        text.count("|") / n,
        len(re.findall(r"\d", text)) / chars,
        len(re.findall(r"[.!?]+(?:\s|$)", text)) / n,
        text.count(",") / n,
        distinct / n,
        math.log1p(distinct) / math.log1p(n),
        1 - len(set(lines)) / len(lines),
        n / len(lines) / (1 + n / len(lines)),
        len(re.findall(r"[A-ZÀ-Ý]", text)) / chars,
        sum(len(w) <= 3 for w in words) / n,
    ]


class Classifier:
    """Logistic regression on standardised looks and their squares, in bounds."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        self.b = np.zeros(2 * x.shape[1] + 1)
        z = self._terms(x)
        for _ in range(40):
            p = self._p(z)
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.eye(len(self.b)), z.T @ (y - p) - self.b)
            self.b += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break

    def _terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack((np.ones((len(z), 1)), z, z * z - 1))

    def _p(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.b, -15, 15)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._p(self._terms(x))


def _labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One label, the larger, for each key with a fold other than 0."""
    return labels.where(f"{label} in (0, 1) and {key} is not null").groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y")).where(fold("k") != 0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Classifier | None:
    """The documents' classifier from at most ``sample_rows`` labelled keys; None without labels."""
    chosen = _labels(labels, key, label).orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(sample_rows)
    ids = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(ids), "k").select("y", "text")

    def measure(batch: pa.RecordBatch) -> dict:
        return {"y": batch.column("y"), "x": [looks(t or "") for t in batch.column("text").to_pylist()]}

    rows = map_batches(sample, measure, "y int, x array<double>").collect()
    return Classifier(np.array([r.x for r in rows]), np.array([r.y for r in rows], float)) if rows else None


def site_of(url: Column, depth: int = 1) -> tuple[Column, Column]:
    """Host (lower-cased, without ``www.`` and port) and the first ``depth`` parts of the path of a URL, for ``score``.

    What is no URL has the empty host and path, as null has; a page at the root has the empty path.
    """
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(text, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    parts = F.filter(F.split(F.regexp_extract(text, r"^[A-Za-z][\w+.-]*://[^/?#]*/([^?#]*)", 1), "/"), lambda x: x != "")
    folders = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))  # the last is the page
    return host, F.when(host == "", F.lit("")).otherwise(F.array_join(F.slice(folders, 1, depth), "/"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame) -> float:
    """By moments: how far sites stray from what is expected of them, beyond chance, as a beta prior's count."""
    r = sites.agg(
        F.sum((F.col("y") - F.col("p")) ** 2).alias("strayed"), F.sum("v").alias("chance"), F.sum(F.col("n") ** 2).alias("squares"), F.sum("y").alias("y"), F.sum("n").alias("n")
    ).first()
    if not r.n:
        return MAX_STRENGTH
    mean = min(max(r.y / r.n, 1e-3), 1 - 1e-3)
    spread = max(0.0, (r.strayed - r.chance) / r.squares)
    return min(MAX_STRENGTH, mean * (1 - mean) / spread) if spread else MAX_STRENGTH


def score(docs: DataFrame, labels: DataFrame, host: str, path: str, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``key, p_document, host_effect, path_effect, score, keep`` for each row.

    ``p_document`` is the classifier's probability, the effects are the shrunken log-odds that the host and the path
    under it add, ``score`` is the probability of good quality, ``keep`` whether it is 0.5 or more. Labels whose fold is
    0 are never used. A null host or path counts as the empty name, a null text as empty; a null key has no label.
    Without labels every score is 0.5. Repeated rows stay; each counts for its site. An empty table gives no rows.
    """
    model = fit(docs, labels, key, text, label, sample_rows)
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("k"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).alias("text"))

    def judge(batch: pa.RecordBatch) -> dict:
        x = np.array([looks(t or "") for t in batch.column("text").to_pylist()])
        p = model(x) if model else np.full(len(x), 0.5)
        return {"k": batch.column("k"), "host": batch.column("host"), "path": batch.column("path"), "p": pa.array(np.clip(p, 1e-6, 1 - 1e-6))}

    judged = checkpointed(map_batches(slim, judge, f"k {kind}, host string, path string, p double"))
    known = judged.join(_labels(labels, key, label), "k")
    sums = lambda *by: known.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("p").alias("p"), F.sum(F.expr("p * (1 - p)")).alias("v"))
    paths = checkpointed(sums("host", "path"))
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "y", "p", "v")))

    def effect(strength: float, expected: Column) -> Column:
        """Log-odds between the posterior mean and what was expected."""
        return _logit((F.col("y") + strength * expected) / (F.col("n") + strength)) - _logit(expected)

    held = lambda p: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    host_effects = hosts.select("host", effect(_strength(hosts), held(F.col("p") / F.col("n"))).alias("host_effect"))
    moved = 1 / (1 + F.exp(-(_logit(held(F.col("p") / F.col("n"))) + F.col("host_effect"))))
    shifted = checkpointed(paths.join(host_effects, "host").withColumn("e", held(moved)))
    strength = _strength(shifted.withColumn("p", F.expr("e * n")))
    path_effects = shifted.select("host", "path", effect(strength, F.col("e")).alias("path_effect"))
    out = judged.join(host_effects, "host", "left").join(path_effects, ["host", "path"], "left").na.fill(0.0, ["host_effect", "path_effect"])
    odds = _logit(F.col("p")) + F.col("host_effect") + F.col("path_effect")
    return out.select(F.col("k").alias(key), F.col("p").alias("p_document"), "host_effect", "path_effect", (1 / (1 + F.exp(-odds))).alias("score")).withColumn("keep", F.col("score") >= 0.5)
