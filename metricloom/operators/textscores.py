"""Corpus BLEU, ROUGE and word features: counts of each row by a vectorised function, sums and formulas by Spark."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions import texts
from metricloom.functions.scalars import div
from metricloom.operators.confidence import Sampling
from metricloom.operators.slicing import SlicingSpec


def _totals(df: DataFrame, specs: Sequence[SlicingSpec], states: dict[str, Column], sampling: Sampling | None) -> tuple[DataFrame, list[str]]:
    """Sums of each slice, by sample if there is a sampling, and the columns that tell them apart."""
    sums = (sampling or Sampling()).sums(df, specs, states)
    return (sums, ["slice_key", "__b"]) if sampling else (sums.drop("__b"), ["slice_key"])


def bleu(df: DataFrame, references: str = "references", hypothesis: str = "hypothesis", specs: Sequence[SlicingSpec] = (), tokenize: str = "13a", lowercase: bool = False, smooth: str = "exp", smooth_value: float | None = None, effective_order: bool = False, sampling: Sampling | None = None) -> DataFrame:
    """``slice_key, value, precisions, brevity, hypothesis_length, reference_length``: BLEU, 0 to 100.

    Orders without matches: ``exp`` halves a pseudo-match each time, ``floor`` puts ``smooth_value`` (0.1), ``add-k`` adds
    it (1) from the second order on, ``none`` gives 0. ``effective_order`` stops at the first order without n-grams.
    """

    @F.pandas_udf("array<double>")
    def counts(h: pd.Series, r: pd.Series) -> pd.Series:
        def one(x, y) -> list[float]:
            m, t, own, other = texts.bleu_counts(x or "", [z or "" for z in (y if y is not None else [])], tokenize, lowercase)
            return [*map(float, m), *map(float, t), float(own), float(other)]

        return pd.Series([one(x, y) for x, y in zip(h, r, strict=True)])

    n = texts.ORDER
    names = [*(f"m{i}" for i in range(n)), *(f"t{i}" for i in range(n)), "own", "other"]
    sums, keys = _totals(df.withColumn("__c", counts(hypothesis, references)), specs, {x: F.col("__c")[i] for i, x in enumerate(names)}, sampling)
    log, orders, empty, gone, precisions = F.lit(0.0), F.lit(0), F.lit(0), F.lit(False), []
    for i in range(n):
        m, t = F.col(f"m{i}"), F.col(f"t{i}")
        if smooth == "add-k" and i:
            k = 1.0 if smooth_value is None else smooth_value
            m, t = m + k, t + k
        gone = gone | (t <= 0)
        zero = m == 0
        empty = empty + F.when(zero & ~gone, 1).otherwise(0)
        put: Column = F.lit(0.0)
        if smooth == "exp":
            put = F.lit(100.0) / (F.pow(F.lit(2.0), empty) * F.when(t > 0, t).otherwise(1.0))
        elif smooth == "floor":
            put = F.lit(100.0 * (0.1 if smooth_value is None else smooth_value)) / F.when(t > 0, t).otherwise(1.0)
        p = F.when(gone, 0.0).when(zero, put).otherwise(100.0 * m / F.when(t > 0, t).otherwise(1.0))
        precisions.append(p)
        orders = orders + F.when(gone, 0).otherwise(1)
        used = ~gone if effective_order else F.lit(True)
        log = log + F.when(~used, 0.0).when(p > 0, F.log(F.when(p > 0, p).otherwise(1.0))).otherwise(-9999999999.0)
    share = F.greatest(orders, F.lit(1)) if effective_order else F.lit(n)
    own, other = F.col("own"), F.col("other")
    brevity = F.when(own >= other, 1.0).when(own > 0, F.exp(1 - other / F.when(own > 0, own).otherwise(1.0))).otherwise(0.0)
    return sums.select(*keys, (brevity * F.exp(log / share)).alias("value"), F.array(*precisions).alias("precisions"), brevity.alias("brevity"), own.alias("hypothesis_length"), other.alias("reference_length"))


def rouge(df: DataFrame, kind: str, references: str = "references", hypothesis: str = "hypothesis", specs: Sequence[SlicingSpec] = (), weight: str | None = None, sampling: Sampling | None = None) -> DataFrame:
    """``slice_key, precision, recall, fmeasure``: weighted means, each row against its best reference."""

    @F.pandas_udf("array<double>")
    def score(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([list(texts.best_rouge(x or "", [z or "" for z in (y if y is not None else [])], kind)) for x, y in zip(h, r, strict=True)])

    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    names = ("precision", "recall", "fmeasure")
    sums, keys = _totals(df.withColumn("__c", score(hypothesis, references)), specs, {"w": w} | {x: w * F.col("__c")[i] for i, x in enumerate(names)}, sampling)
    return sums.select(*keys, *(div(F.col(x), F.col("w")).alias(x) for x in names))


def plain_words(text: Column) -> Column:
    """Distinct lower-case words without ASCII punctuation: a feature with many values."""
    bare = F.translate(F.lower(text), r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", "")
    return F.array_distinct(F.filter(F.split(bare, r"\s+"), lambda w: w != ""))
