"""Samples of rows and confidence intervals: jackknife and Poisson bootstrap for all that comes from sums.

A source of results gives its values by sample, ``__b``: of all rows (-1) and of each sample. One aggregation then makes
intervals of any of them: of metrics, of points of curves and cells, of differences between slices."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import t_quantile
from metricloom.operators.slicing import SlicingSpec, grouped_sums

#: Values of metrics over state columns, by name.
Values = dict[str, Callable[[dict[str, Column]], Column]]
#: The number of the sample that is all rows.
WHOLE = -1


@dataclass(frozen=True)
class Sampling:
    """How samples are drawn: ``jackknife`` by a row's bucket, ``bootstrap`` by its number in [0, 1) for each sample, or none."""

    kind: str | None = None
    samples: int = 20
    bucket: Column | None = None
    uniform: Callable[[int], Column] | None = None

    def pinned(self, df: DataFrame) -> tuple[DataFrame, Sampling]:
        """The rows with a column that tells their samples, and the sampling by it, whatever becomes of their other columns."""
        if self.kind == "jackknife":
            return df.withColumn("__drawn", self.bucket.cast("int")), replace(self, bucket=F.col("__drawn"))
        if self.kind == "bootstrap":  # one hash for all samples
            return df.withColumn("__drawn", self.bucket), replace(self, uniform=hashed_uniform(["__drawn"]))
        return df, self

    def parts(self, df: DataFrame, specs: Sequence[SlicingSpec], states: dict[str, Column], by: Sequence[str] = (), kinds: dict[str, str] | None = None, grouped: Callable[..., DataFrame] = grouped_sums) -> DataFrame:
        """``slice_key, *by, __b`` and the states: by sample, but by bucket for the jackknife, whose samples are what a bucket
        leaves; whatever is linear in sums can be done to buckets before ``samples_of``. ``grouped``: how rows are summed."""
        if self.kind == "jackknife":
            return grouped(df.withColumn("__b", self.bucket.cast("int")), specs, states, [*by, "__b"], kinds)
        if self.kind is None:
            return grouped(df, specs, states, by, kinds).withColumn("__b", F.lit(WHOLE))
        names, kinds = list(states), kinds or {}
        drawn = df.withColumns({f"__u{i}": self.uniform(i) for i in range(self.samples)} | {f"__s{k}": c for k, c in enumerate(states.values())})
        counted = drawn.withColumns({f"__k{i}": poisson_counts(F.col(f"__u{i}")) for i in range(self.samples)})
        own = {n: F.col(f"__s{k}") for k, n in enumerate(names)}
        # all samples' sums are columns of one aggregation, so rows are neither repeated nor moved for them
        of = lambda i, n: F.when(F.col(f"__k{i}") > 0, own[n]) if kinds.get(n) in ("min", "max") else F.col(f"__k{i}") * own[n]
        all_kinds = kinds | {f"{n}#{i}": k for n, k in kinds.items() for i in range(self.samples)}
        sums = grouped(counted, specs, own | {f"{n}#{i}": of(i, n) for i in range(self.samples) for n in names}, by, all_kinds)
        each = [F.struct(F.lit(i).alias("__b"), *(F.col(f"`{n}#{i}`" if i >= 0 else f"`{n}`").alias(n) for n in names)) for i in range(WHOLE, self.samples)]
        return sums.select("slice_key", *(f"`{c}`" for c in by), F.inline(F.array(*each)))

    def samples_of(self, parts: DataFrame, keys: Sequence[str], names: Sequence[str], kinds: dict[str, str] | None = None) -> DataFrame:
        """``*keys, __b`` and the sums of each sample. The buckets of one key, no more than there are samples, stand together."""
        if self.kind != "jackknife":
            return parts
        kinds, quoted = kinds or {}, [f"`{k}`" for k in keys]
        total = [getattr(F, kinds.get(n, "sum"))(f"`{n}`").alias(f"__t{k}") for k, n in enumerate(names)]
        lists = parts.groupBy(*quoted).agg(F.collect_list(F.struct("__b", *(F.col(f"`{n}`").alias(f"s{k}") for k, n in enumerate(names)))).alias("__l"), *total)
        each = lists.withColumn("__b", F.explode(F.sequence(F.lit(WHOLE), F.lit(self.samples - 1))))
        own = each.withColumn("__own", F.try_element_at(F.filter("__l", lambda x: x["__b"] == F.col("__b")), F.lit(1)))

        def left(k: int, n: str) -> Column:
            if n in kinds and kinds[n] != "sum":
                return getattr(F, f"array_{kinds[n]}")(F.transform(F.filter("__l", lambda x: x["__b"] != F.col("__b")), lambda x: x[f"s{k}"]))
            return F.col(f"__t{k}") - F.coalesce(F.col(f"__own.s{k}"), F.lit(0.0))

        return own.select(*quoted, "__b", *(left(k, n).alias(n) for k, n in enumerate(names)))

    def sums(self, df: DataFrame, specs: Sequence[SlicingSpec], states: dict[str, Column], by: Sequence[str] = (), kinds: dict[str, str] | None = None, grouped: Callable[..., DataFrame] = grouped_sums) -> DataFrame:
        """``slice_key, *by, __b`` and the states of all rows and of each sample."""
        return self.samples_of(self.parts(df, specs, states, by, kinds, grouped), ["slice_key", *by], list(states), kinds)

    @property
    def spread(self) -> float:
        """How far samples stray from each other less than results do: pseudo-values n x - (n - 1) x_i stray n - 1 times as far."""
        return (self.samples - 1) / self.samples**0.5 if self.kind == "jackknife" else 1.0


def intervals(samples: DataFrame, sampling: Sampling, keys: Sequence[str], skip: Column | None = None) -> DataFrame:
    """``*keys, value, sample_mean, standard_error, lower, upper, samples, problem`` from ``*keys, __b, value``.

    Bounds lie around the samples' mean. A key of which not all samples have a value gets none, and ``problem`` says so; one
    for which ``skip`` holds gets none and has no problem. A column ``change`` beside the value has ``change_error``,
    ``change_lower`` and ``change_upper`` in the same way, from the same aggregation.
    """
    sample, n = F.col("__b") != WHOLE, sampling.samples
    quoted, t = [f"`{k}`" for k in keys], t_quantile(0.975, sampling.samples - 1)
    more = "change" in samples.columns
    sums = [F.max(F.lit(False) if skip is None else skip).alias("__skip")]
    for name in ("value", *(["change"] if more else [])):
        drawn = F.when(sample if skip is None else sample & ~skip, F.col(name))
        sums += [
            F.max(F.when(~sample, F.col(name))).alias(name), F.avg(drawn).alias(f"__m_{name}"), (F.stddev_samp(drawn) * sampling.spread).alias(f"__e_{name}"),
            F.count(F.when(drawn.isNotNull() & ~F.isnan(drawn), 1)).alias(f"__n_{name}"),
        ]
    stats = samples.groupBy(*quoted).agg(*sums)
    part = lambda name: (F.col(f"__n_{name}") == n, F.col(f"__m_{name}"), F.col(f"__e_{name}"))
    ok, m, e = part("value")
    told = F.concat(F.lit("no interval: "), F.col("__n_value").cast("string"), F.lit(f" of {n} samples have a value"))
    out = [
        "value", F.when(ok, m).alias("sample_mean"), F.when(ok, e).alias("standard_error"), F.when(ok, m - t * e).alias("lower"), F.when(ok, m + t * e).alias("upper"), F.col("__n_value").alias("samples"),
        F.when(~ok & ~F.col("__skip"), told).alias("problem"),
    ]
    if more:
        ok, m, e = part("change")
        out += ["change", F.when(ok, e).alias("change_error"), F.when(ok, m - t * e).alias("change_lower"), F.when(ok, m + t * e).alias("change_upper")]
    return stats.select(*quoted, *out)


def _long(frame: DataFrame, values: Values, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    state = {n: F.col(f"`{n}`") for n in names}
    return frame.select(*keep, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), v(state).cast("double").alias("value")) for m, v in values.items()))))


def _sampled(df: DataFrame, states: dict[str, Column], values: Values, specs: Sequence[SlicingSpec], sampling: Sampling) -> DataFrame:
    each = _long(sampling.sums(df, specs, states), values, list(states), ["slice_key", "__b"])
    return intervals(each, sampling, ["slice_key", "metric"]).drop("problem")


def jackknife(df: DataFrame, states: dict[str, Column], values: Values, bucket: Column, specs: Sequence[SlicingSpec] = (), samples: int = 20) -> DataFrame:
    """``slice_key, metric, value, sample_mean, standard_error, lower, upper, samples``.

    ``bucket``: a row's bucket, 0 to ``samples`` - 1, by a hash of what identifies the row. Sums are taken once for each
    slice and bucket; a sample is the total less a bucket.
    """
    return _sampled(df, states, values, specs, Sampling("jackknife", samples, bucket))


def poisson_counts(uniform: Column) -> Column:
    """How often a row is drawn, from a number in [0, 1): the inverse of the Poisson distribution with mean 1."""
    import math

    below, out = 0.0, None
    for k in range(12):  # most rows end at the first bounds
        below += math.exp(-1) / math.factorial(k)
        out = F.when(uniform < below, float(k)) if out is None else out.when(uniform < below, float(k))
    return out.otherwise(12.0)


def bootstrap(df: DataFrame, states: dict[str, Column], values: Values, uniform: Callable[[int], Column], specs: Sequence[SlicingSpec] = (), samples: int = 20) -> DataFrame:
    """The same columns from samples in which each row counts a Poisson number of times.

    ``uniform(i)``: a row's number in [0, 1) for sample ``i``, by a hash.
    """
    return _sampled(df, states, values, specs, Sampling("bootstrap", samples, uniform=uniform))


def hashed_bucket(columns: Sequence[str], samples: int = 20, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(samples))


def hashed_uniform(columns: Sequence[str], seed: int = 0) -> Callable[[int], Column]:
    return lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *columns), F.lit(1 << 52)) / float(1 << 52)
