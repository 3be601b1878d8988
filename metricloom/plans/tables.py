"""Results as flat tables, and look-ups in them: by slice, by features of slices, by metric, over runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.inputs import weight_or_one
from metricloom.operators.slicing import SlicingSpec, applies, slice_keys, slice_name
from metricloom.plans.config import EvalConfig

#: What tells results apart beside their slices, as far as a table has it.
KEYS = ("run", "model", "output", "metric", "sub_key", "measure", "feature", "threshold", "cell")


def analysis(df: DataFrame, config: EvalConfig, columns: Sequence[str] = ()) -> DataFrame:
    """The rows as metrics see them: the named columns, ``slices`` by name, and each model's label, prediction and weight."""
    names = F.transform(slice_keys(df, config.slices), slice_name).alias("slices")
    own = []
    for model in config.models:
        of = f"{model.name}#{model.output}/" if model.output else f"{model.name}/" if model.name else ""
        weight = weight_or_one(F.expr(model.weight) if model.weight else None)
        own += [F.expr(model.label).alias(f"{of}label"), F.expr(model.prediction).alias(f"{of}prediction"), weight.alias(f"{of}weight")]
    return df.select(*(f"`{c}`" for c in columns), names, *own)


def counterfactual(df: DataFrame, model: Callable[[dict[str, Column]], Column], features: Sequence[str], changes: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """The rows with a column for each named change: what a model predicts where some of its features are other columns.

    ``model`` takes its features as columns by name, and may well be a vectorised function; a change without entries is the
    prediction as it is.
    """
    for name, given in changes.items():
        if unknown := set(given) - set(features):
            raise ValueError(f"{name} changes {', '.join(sorted(unknown))}, which the model doesn't take")
    return df.withColumns({name: model({f: given.get(f, F.col(f"`{f}`")) for f in features}) for name, given in changes.items()})


def by_features(results: DataFrame, features: Sequence[str]) -> DataFrame:
    """A column ``slice.<feature>`` for each named feature: the slice's value of it, null where it is not sliced by it."""

    def value(name: str) -> Column:
        return F.try_element_at(F.transform(F.filter("slice_key", lambda s: s["key"] == name), lambda s: s["value"]), F.lit(1))

    rest = [c for c in results.columns if c not in ("slice_key", "slice")]
    return results.select("slice", *(value(f).alias(f"slice.{f}") for f in features), *(f"`{c}`" for c in rest))


def points(plots: DataFrame) -> DataFrame:
    """Plots with a column for each coordinate that a point can have, and one for each measure: a row for each point."""
    names = ("threshold", "lower", "upper", "actual", "predicted", "class_id")
    at = [F.try_element_at(F.transform(F.filter("point", lambda p: p["key"] == n), lambda p: p["value"]), F.lit(1)).alias(n) for n in names]
    keys = [c for c in ("slice_key", "slice", "run", "model", "output", "metric", "sub_key") if c in plots.columns]
    measures = ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy", "false_positive_rate", "false_omission_rate", "w", "wl", "wp", "above", "below")
    flat = plots.select(*keys, *at, "measure", "value").groupBy(*keys, *names)
    return flat.agg(*(F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in measures))


def lookup(results: DataFrame, spec: SlicingSpec | None = None, **wanted: str | None) -> DataFrame:
    """The results of the slices of a spec, and of given models, metrics, sub-keys and so on; None asks for null.

    More than one slice may be of a spec; ``only`` is for one that must be one.
    """
    out = results if spec is None else results.where(applies(F.col("slice_key"), spec))
    for name, value in wanted.items():
        if name not in KEYS or name not in results.columns:
            raise ValueError(f"results are not told apart by {name}")
        out = out.where(F.col(name).eqNullSafe(F.lit(value)))
    return out


def only(results: DataFrame, spec: SlicingSpec | None = None, **wanted: str | None) -> float | None:
    """The one value that a look-up finds; none or several are an error."""
    found = lookup(results, spec, **wanted).select("value").limit(2).collect()
    if len(found) != 1:
        raise ValueError("no result is this" if not found else "several results are this: tell more of them")
    return found[0].value


def series(runs: DataFrame, metrics: Sequence[str], spec: SlicingSpec, model: str = "") -> DataFrame:
    """A row for each run and slice of a spec, in order of runs, with a column for each metric and its change since the run before."""
    from pyspark.sql import Window

    found = lookup(runs, spec, model=model).where(F.col("metric").isin(*metrics))
    if "sub_key" in found.columns:
        found = found.where("sub_key IS NULL")
    table = found.groupBy("run", "slice").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics))
    order = Window.partitionBy("slice").orderBy("run")
    return table.withColumns({f"{m}/change": F.col(f"`{m}`") - F.lag(F.col(f"`{m}`")).over(order) for m in metrics})
