"""From a configuration to results: one aggregation for all metrics over sums of all models and slices, then expressions.

Every source of results, sums, classes, curves, rankings, texts and boxes, gives rows ``slice_key, model, output, metric,
sub_key, __b, value``, where ``__b`` is the sample. Metrics over other metrics, averages over outputs, functions of two
slices and intervals are made of these rows alike, wherever they come from.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.inputs import weight_or_one
from metricloom.functions.scalars import div
from metricloom.operators import confidence, curves, ranking, slicing, textscores, validation
from metricloom.operators.confidence import Sampling
from metricloom.operators.metrics import PAIRED, CrossSlice, Derived, Metric, Row, make
from metricloom.plans import families, plots
from metricloom.plans.config import EvalConfig, MetricConfig, ModelSpec, Options

#: Metrics of whole curves, whose values come from a histogram of predictions, with the parameters that they take.
CURVES = {"AUC": ("curve", "method", "num_thresholds"), "AUCPrecisionRecall": ("method", "num_thresholds")} | {n: ("bound", "num_thresholds") for n in curves.CONSTRAINED}
#: How a curve metric is drawn unless its parameters say otherwise.
CURVE_DEFAULTS = {"curve": "ROC", "method": "interpolation", "num_thresholds": 200}


@dataclass(frozen=True)
class Item:
    """A configured metric under the name that results have it by; ``made`` if it is registered as a function of sums or values."""

    config: MetricConfig
    name: str
    made: Metric | Derived | CrossSlice | None = None

    @property
    def group(self) -> tuple:
        """What metrics of the same rows share: how classes become rows, and how they are averaged."""
        c = self.config
        return c.class_ids, c.ks, c.top_ks, c.average, tuple(sorted(c.class_weights.items()))

    @property
    def curve(self) -> bool:
        return self.config.name in CURVES


def items(config: EvalConfig) -> list[Item]:
    """The configured metrics by name; two that would be called the same must be the same."""
    out: dict[tuple, Item] = {}
    for wanted in config.metrics:
        one = Item(wanted, *_named(wanted))
        before = out.setdefault((one.name, one.group), one)
        if before.config != wanted:
            raise ValueError(f"two metrics are called {one.name}: give one an alias")
    return list(out.values())


def _named(wanted: MetricConfig) -> tuple[str, Metric | Derived | CrossSlice | None]:
    for known, why in ((families.FAMILIES, "several values"), (plots.PLOTS, "a plot")):
        if wanted.name in known:
            if wanted.alias:
                raise ValueError(f"{wanted.name} is {why} and takes no alias")
            return wanted.name, None
    if wanted.name in CURVES:
        unknown = set(wanted.params) - set(CURVES[wanted.name])
        if unknown:
            raise ValueError(f"{wanted.name} has no parameter {', '.join(sorted(unknown))}")
        if wanted.alias:
            return wanted.alias, None
        name = "AUCPrecisionRecall" if wanted.params.get("curve") == "PR" else wanted.name
        name += f"@{wanted.params['bound']:g}" if "bound" in CURVES[wanted.name] else ""
        more = [f"{k}={v}" for k, v in sorted(wanted.params.items()) if k not in ("bound", "curve") and v != CURVE_DEFAULTS[k]]
        return name + (f"[{','.join(more)}]" if more else ""), None
    made = make(wanted.name, **wanted.params)
    return wanted.alias or made.name, made


def private(name: str) -> bool:
    """Names with one underscore in front are for other metrics."""
    return name.startswith("_") and not name.startswith("__")


@dataclass
class Plan:
    """Shared sums by name, each metric's value over them, then metrics over values in the order that they need each other.

    Values stand in columns by label, which tells model, output and metric.
    """

    states: dict[str, Column] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    values: dict[str, Callable[[dict[str, Column]], Column]] = field(default_factory=dict)
    derived: list[tuple[str, Derived, dict[str, str]]] = field(default_factory=list)
    #: Label to model, metric and whether it only helps others.
    labels: dict[str, tuple[ModelSpec, str, bool]] = field(default_factory=dict)

    def shown(self) -> list[str]:
        return [x for x, (_, _, hidden) in self.labels.items() if not hidden]


def _label(model: ModelSpec, name: str) -> str:
    of = f"{model.name}#{model.output}" if model.output else model.name
    return f"{of}/{name}" if of else name


def plan(config: EvalConfig, found: Sequence[Item] | None = None) -> Plan:
    """Sums that several metrics need are there once, and so is a metric that others need; metrics of two models belong to
    the candidate. Metrics over values that are no values of sums are left out here."""
    found = [i for i in items(config) if not i.config.keyed] if found is None else found
    configured, out = {i.name for i in found}, Plan()
    own = [(i.name, i.made, private(i.name)) for i in found if isinstance(i.made, Metric)]
    over = [(i.name, i.made) for i in found if isinstance(i.made, Derived) and i.made.stage == "values"]
    for made in (i.made for i in found if isinstance(i.made, Derived | CrossSlice)):
        for name, params in made.helpers:
            helper = make(name, **params)
            if helper.name not in configured:
                configured.add(helper.name)
                own.append((helper.name, helper, True))
    for model in config.models:
        prefix = _label(model, "")
        for name, metric, hidden in own:
            if metric.name.split("@")[0] in PAIRED:
                if config.baseline is None:
                    raise ValueError(f"{metric.name} needs a baseline model")
                if model.is_baseline:
                    continue
            row = _row(model, config.baseline_of(model) if metric.name.split("@")[0] in PAIRED else None)
            for state, amount in metric.states.items():
                out.states.setdefault(prefix + state, amount(row))
                if state in metric.kinds:
                    out.kinds[prefix + state] = metric.kinds[state]
            out.values[_label(model, name)] = _value(metric, prefix)
            out.labels[_label(model, name)] = (model, name, hidden)
        waiting = list(over)
        while ready := [(n, d) for n, d in waiting if all(_label(model, x) in out.labels for x in d.needs)]:
            for name, made in ready:
                out.derived.append((_label(model, name), made, {x: _label(model, x) for x in made.needs}))
                out.labels[_label(model, name)] = (model, name, private(name))
            waiting = [x for x in waiting if x not in ready]
    return out


def _row(model: ModelSpec, baseline: ModelSpec | None) -> Row:
    weight = weight_or_one(F.expr(model.weight) if model.weight else None)
    return Row(F.expr(model.label), F.expr(model.prediction), weight, F.expr(baseline.prediction) if baseline else None)


def _value(metric: Metric, prefix: str):
    return lambda s: metric.value({n: s[prefix + n] for n in metric.states})


def valued(sums: DataFrame, p: Plan, keep: Sequence[str]) -> DataFrame:
    """The columns to keep and one for each label: values over sums, then values over these."""
    state = {n: F.col(f"`{n}`") for n in p.states}
    out = sums.select(*(f"`{c}`" for c in keep), *(v(state).alias(label) for label, v in p.values.items()))
    for label, made, needs in p.derived:
        out = out.withColumn(label, made.column({n: f"`{x}`" for n, x in needs.items()}))
    return out


def wide(df: DataFrame, config: EvalConfig, by: Sequence[str] = ()) -> DataFrame:
    """``slice_key``, the columns of ``by`` and a column for each metric over sums, named ``model/metric`` if the model
    has a name."""
    p = plan(config.verified())
    sums = slicing.grouped_sums(df, config.slices, p.states, by, p.kinds)
    return valued(sums, p, ["slice_key", *by]).select("slice_key", *(f"`{c}`" for c in by), *(f"`{x}`" for x in p.shown()))


# --- rows of results by sample ----------------------------------------------------------------------------------------


def _long(frame: DataFrame, p: Plan, keep: Sequence[str] = ()) -> DataFrame:
    rows = [F.struct(F.lit(m.name).alias("model"), F.lit(m.output).alias("output"), F.lit(n).alias("metric"), F.col(f"`{label}`").cast("double").alias("value"), F.lit(hidden).alias("__hidden")) for label, (m, n, hidden) in p.labels.items()]
    return frame.select("slice_key", "__b", *keep, F.inline(F.array(*rows)))


def _of(rows: DataFrame, model: ModelSpec, hidden: Sequence[str] = ()) -> DataFrame:
    return rows.withColumns({"model": F.lit(model.name), "output": F.lit(model.output), "__hidden": F.col("metric").isin(*hidden) if hidden else F.lit(False)})


def _joined(parts: Sequence[DataFrame | None]) -> DataFrame | None:
    out = None
    for one in parts:
        if one is not None:
            one = one if "sub_key" in one.columns else one.withColumn("sub_key", F.lit(None).cast("string"))
            out = one if out is None else out.unionByName(one)
    return out


def sampled(df: DataFrame, options: Options) -> tuple[DataFrame, Sampling]:
    """The rows with their samples, told by the columns that identify a row, or by all columns but maps."""
    columns = [f"`{c}`" for c in list(options.identity) or [c for c, t in df.dtypes if not t.startswith("map")]]
    if options.intervals == "bootstrap":
        bucket = F.xxhash64(F.lit(options.seed), *columns)
    else:
        bucket = F.expr(options.bucket) if options.bucket else confidence.hashed_bucket(columns, options.samples, options.seed)
    return Sampling(options.intervals, options.samples, bucket).pinned(df)


def sum_rows(df: DataFrame, config: EvalConfig, found: Sequence[Item], sampling: Sampling, keep: Sequence[str] = ()) -> DataFrame | None:
    """Metrics over sums and metrics over these: one aggregation for all of them."""
    p = plan(config, found)
    if not p.labels:
        return None
    sums = sampling.sums(df, config.slices, p.states, keep, p.kinds)
    return _long(valued(sums, p, ["slice_key", *keep, "__b"]), p, keep)


def curve_rows(df: DataFrame, config: EvalConfig, found: Sequence[Item], sampling: Sampling, keep: Sequence[str] = ()) -> DataFrame | None:
    """Metrics of curves: each model has one histogram, and all its metrics at one number of thresholds are one aggregation.

    Parameters: ``num_thresholds`` (200), ``curve`` and ``method`` of AUC, ``bound`` of metrics under a constraint.
    """
    wanted: dict[int, tuple[dict, dict]] = {}
    for item in found:
        if item.curve:
            params = CURVE_DEFAULTS | item.config.params
            areas, bounds = wanted.setdefault(params["num_thresholds"], ({}, {}))
            if "bound" in CURVES[item.config.name]:
                bounds[item.name] = (item.config.name, params["bound"])
            else:
                areas[item.name] = ("PR" if item.config.name == "AUCPrecisionRecall" else params["curve"], params["method"])
    out = []
    for model in config.models if wanted else ():
        hist = histogram(df, model, config.slices, sampling, keep)
        for count, (areas, bounds) in wanted.items():
            cells = curves.matrices(hist, curves.interpolated_thresholds(count), by=[*keep, "__b"])
            each = sampling.samples_of(cells, ["slice_key", *keep, "threshold"], curves.CELLS)
            found_here = curves.unpivot(curves.summary(each, areas, bounds, [*keep, "__b"]), [*areas, *bounds], [*keep, "__b"])
            out.append(_of(found_here, model, [n for n in (*areas, *bounds) if private(n)]))
    return _joined(out)


def histogram(df: DataFrame, model: ModelSpec, specs: Sequence[slicing.SlicingSpec], sampling: Sampling, keep: Sequence[str] = ()) -> DataFrame:
    """``slice_key, *keep, bucket, __b, w, wl, wp``: the histogram of a model's predictions by sample, or by the jackknife's bucket."""
    row = _row(model, None)
    rows = curves.bucketed(df.withColumns({"__label": row.label.cast("double"), "__prediction": row.prediction.cast("double"), "__weight": row.weight}), "__prediction")
    w, l, p = (F.col(c) for c in ("__weight", "__label", "__prediction"))
    return sampling.parts(rows, specs, {"w": w, "wl": w * l, "wp": w * F.nanvl(p, F.lit(0.0))}, [*keep, "bucket"])


def family_rows(df: DataFrame, config: EvalConfig, found: Sequence[Item], sampling: Sampling) -> DataFrame | None:
    """Rankings, text scores, sets and boxes."""
    out = []
    for item in found:
        if item.config.name in families.FAMILIES:
            for model in config.models:
                row = _row(model, None)
                rows = df.withColumns({"__label": row.label, "__prediction": row.prediction, "__weight": row.weight})
                out.append(_of(families.FAMILIES[item.config.name].rows(rows, config.slices, item.config.params, sampling), model))
    return _joined(out)


def keyed_rows(df: DataFrame, config: EvalConfig, found: Sequence[Item], sampling: Sampling) -> DataFrame | None:
    """Metrics over classes: a class, the k-th best, the best k, an average of classes.

    Rows of one model and one choice of sub-keys are made once for all metrics that share it.
    """
    groups: dict[tuple, list[Item]] = {}
    for item in found:
        if item.config.keyed:
            if item.config.name in families.FAMILIES or item.config.name in plots.PLOTS:
                raise ValueError(f"{item.config.name} is not of single classes")
            groups.setdefault(item.group, []).append(item)
    out = []
    for (classes, ks, top_ks, how, weights), own in groups.items():
        here = {name for _, name, _ in plan(replace(config, models=(ModelSpec(),)), own).labels.values()} | {i.name for i in own if i.curve}
        for item in own:
            if isinstance(item.made, Derived) and (item.made.stage != "values" or item.name not in here):
                raise ValueError(f"{item.name} of classes is over values of sums of the same classes")
        for model in config.models:
            row = _row(model, None)
            arrays = df.withColumns({"__label": row.label, "__prediction": row.prediction, "__weight": row.weight})
            rows = binarized(arrays, classes, ks, top_ks, "__label", "__prediction")
            table = F.create_map(*(F.lit(x) for c, v in weights for x in (f"class:{c}", v))) if weights else None
            share = F.lit(1.0) if table is None else F.coalesce(F.try_element_at(table, F.col("sub_key")), F.lit(0.0))
            if how == "micro":
                rows = rows.withColumn("__weight", F.col("__weight") * share)
            inner = replace(config, models=(ModelSpec("__label", "__prediction", "__weight"),))
            keep = [] if how == "micro" else ["sub_key"]
            one = _joined([sum_rows(rows, inner, own, sampling, keep), curve_rows(rows, inner, own, sampling, keep)])
            if one is None:
                continue
            if how in ("macro", "weighted_macro"):
                if how == "weighted_macro":  # a class's share of the positives
                    positives = sampling.sums(rows, config.slices, {"__n": F.col("__weight") * F.col("__label")}, ["sub_key"])
                    one = one.join(positives, ["slice_key", "sub_key", "__b"])
                    share = share * F.col("__n")
                valued_ = one.withColumn("__w", share).groupBy("slice_key", "__b", "metric", "__hidden")
                one = valued_.agg(div(F.sum(F.when(F.col("__w") != 0, F.col("value") * F.col("__w")).otherwise(0.0)), F.sum("__w")).alias("value"))
            one = one.withColumn("sub_key", F.lit(how)) if how else one
            out.append(one.withColumns({"model": F.lit(model.name), "output": F.lit(model.output)}))
    return _joined(out)


def binarized(df: DataFrame, class_ids: Sequence[int] = (), ks: Sequence[int] = (), top_ks: Sequence[int] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A row for each sub-key (``class:1``, ``k:2``, ``top_k:3``) of rows with dense arrays.

    A class stands alone; the k-th best prediction comes with its label; of the best k each class is a row, and
    predictions outside them are minus infinity.
    """
    from metricloom.functions import inputs

    p, l = F.col(prediction), F.col(label)
    one = lambda name, a, b: F.array(F.struct(F.lit(name).alias("sub_key"), a.cast("double").alias("l"), b.cast("double").alias("p")))
    parts = [one(f"class:{c}", inputs.at_class(l, c), inputs.at_class(p, c)) for c in class_ids]
    for k in ks:
        best, own = inputs.kth(p, l, k)
        parts.append(one(f"k:{k}", own, best))
    for k in top_ks:
        parts.append(F.zip_with(l, inputs.keep_top_k(p, k), _sub_key(f"top_k:{k}")))
    out = df.withColumn("__z", F.explode(F.concat(*parts)))
    return out.withColumns({"sub_key": F.col("__z.sub_key"), label: F.col("__z.l"), prediction: F.col("__z.p")}).drop("__z")


def _sub_key(name: str):
    return lambda a, b: F.struct(F.lit(name).alias("sub_key"), a.cast("double").alias("l"), b.cast("double").alias("p"))


# --- results over results ---------------------------------------------------------------------------------------------

#: What tells a result apart, beside its slice and metric.
KEYS = ("model", "output", "sub_key")


def _side_by_side(rows: DataFrame, keys: Sequence[str], needs: Sequence[str], value: Column) -> DataFrame:
    """A column for each needed metric; rows where one isn't there are left out."""
    found = rows.where(F.col("metric").isin(*needs)).groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == n, value)).alias(n) for n in needs))
    return found.where(" AND ".join(f"`{n}` IS NOT NULL" for n in needs))


def later_rows(rows: DataFrame, over: Sequence[tuple[str, Derived]]) -> DataFrame:
    """The rows and those of metrics over them, in the order that they need each other."""
    waiting = list(over)
    order = []
    while waiting:
        ready = [(n, d) for n, d in waiting if not any(n2 in d.needs for n2, _ in waiting)]
        if not ready:
            raise ValueError(f"metrics need each other in a circle: {', '.join(sorted(n for n, _ in waiting))}")
        order += ready
        waiting = [x for x in waiting if x not in ready]
    for name, made in order:
        wide_ = _side_by_side(rows, ["slice_key", *KEYS, "__b"], made.needs, F.col("value"))
        own = wide_.select("slice_key", *KEYS, "__b", F.lit(name).alias("metric"), made.column({n: f"`{n}`" for n in made.needs}).cast("double").alias("value"), F.lit(private(name)).alias("__hidden"))
        rows = rows.unionByName(own)
    return rows


def _check_needs(config: EvalConfig, found: Sequence[Item]) -> None:
    """Every needed metric is configured or brought along."""
    names = {i.name for i in found} | {make(n, **p).name for i in found if isinstance(i.made, Derived | CrossSlice) for n, p in i.made.helpers}
    names |= {n for i in found if i.config.name in families.FAMILIES for n in families.FAMILIES[i.config.name].names(i.config.params)}
    for item in found:
        for need in getattr(item.made, "needs", ()):
            if need not in names:
                raise ValueError(f"{item.name} needs {need}, which is not there")


def output_averages(rows: DataFrame, found: Sequence[Item]) -> DataFrame:
    """The rows and an average over a model's outputs for each metric that has weights for them; NaN without a weight."""
    extra = []
    for item in found:
        if item.config.output_weights:
            table = F.create_map(*(F.lit(x) for k, v in item.config.output_weights.items() for x in (k, float(v))))
            own = rows.where((F.col("metric") == item.name)).withColumn("__w", F.try_element_at(table, F.col("output"))).where("__w is not null")
            mean = own.groupBy("slice_key", "model", "metric", "sub_key", "__b", "__hidden").agg(div(F.sum(F.col("value") * F.col("__w")), F.sum("__w")).alias("value"))
            extra.append(mean.withColumn("output", F.lit("average")))
    for one in extra:
        rows = rows.unionByName(one)
    return rows


def model_differences(metrics: DataFrame, baseline: str, paired: Sequence[str] = tuple(PAIRED)) -> DataFrame:
    """``change``: a candidate's value less the baseline's of the same slice, metric, output and sub-key; null for the baseline."""
    keys = ["slice_key", "metric", *(c for c in ("output", "sub_key", "__b", "__hidden") if c in metrics.columns)]
    base = F.max(F.when(F.col("model") == baseline, F.col("value"))).over(Window.partitionBy(*keys))
    return metrics.withColumn("change", F.when((F.col("model") != baseline) & ~F.col("metric").isin(*paired), F.col("value") - base))


def crossed_rows(rows: DataFrame, config: EvalConfig, found: Sequence[Item]) -> DataFrame:
    """``baseline_key, comparison_key, model, output, metric, sub_key, __b, value, __hidden``: differences of all metrics between two slices,
    and the configured functions of two slices. Two values meet only if all but their slices is the same."""
    named = rows.withColumn("sub_key", F.coalesce("sub_key", F.lit("")))
    out = []
    for spec in config.cross_slices:
        out.append(slicing.cross_slices(named, spec.baseline, spec.comparisons, on=("model", "output", "sub_key", "metric", "__b", "__hidden")))
        for item in found:
            if isinstance(item.made, CrossSlice):
                each = _side_by_side(named, ["slice_key", *KEYS, "__b"], item.made.needs, F.col("value"))
                both = each.select("slice_key", *KEYS, "__b", F.struct(*(F.col(f"`{n}`").alias(n) for n in item.made.needs)).alias("value"))
                met = slicing.slice_pairs(both, spec.baseline, spec.comparisons, on=(*KEYS, "__b"))
                out.append(met.withColumns({"metric": F.lit(item.name), "value": item.made.column().cast("double"), "__hidden": F.lit(private(item.name))}).drop("base", "other"))
    return _joined(out).withColumn("sub_key", F.nullif("sub_key", F.lit("")))


def evaluate(df: DataFrame, config: EvalConfig) -> dict[str, DataFrame]:
    """``metrics`` (slice_key, slice, model, metric, value and more by the options), and ``plots``, ``attributions``, ``examples``
    (ids of rows in cells), ``cross_slices``, ``validations`` and ``missing_slices`` where they are configured.

    ``change`` is there with a baseline model, ``sub_key`` with metrics over classes, ``output`` with models of several outputs, ``error`` with a least size
    of slices or with intervals: it says why a value or an interval is missing.
    """
    config = config.verified()
    found, options = items(config), config.options
    _check_needs(config, found)
    plain = [i for i in found if not i.config.keyed]
    df, sampling = sampled(df, options)
    rows = _joined([sum_rows(df, config, plain, sampling), curve_rows(df, config, plain, sampling), family_rows(df, config, plain, sampling), keyed_rows(df, config, found, sampling)])
    drawn = plots.plot_rows(df, config, found, sampling)
    if rows is None and drawn is None:
        raise ValueError("there are no metrics")
    small = slicing.grouped_sums(df, config.slices, {"n": F.lit(1)}) if options.min_slice_size > 1 else None
    out = {}
    if drawn is not None:
        whole = _finished(drawn, config, found, sampling, ["slice_key", "model", "output", "metric", "sub_key", "point", "measure"], small)
        by_feature = F.col("metric").isin(*plots.ATTRIBUTIONS)
        if any(i.config.name in plots.ATTRIBUTIONS for i in found):
            out["attributions"] = whole.where(by_feature).withColumnRenamed("measure", "feature").drop("point")
        if any(i.config.name in plots.PLOTS and i.config.name not in plots.ATTRIBUTIONS for i in found):
            out["plots"] = whole.where(~by_feature)
    examples = plots.example_rows(df, config, found)
    if examples is not None:
        if small is not None:
            examples = slicing.hide_small(examples, small, options.min_slice_size, "ids")
        out["examples"] = examples.withColumn("slice", slicing.slice_name(F.col("slice_key")))
    if rows is None:
        return out
    early = {n for _, n, _ in plan(config, plain).labels.values()} | {i.name for i in found if i.config.keyed}
    over = [(i.name, i.made) for i in plain if isinstance(i.made, Derived) and i.made.stage == "values" and i.name not in early]
    rows = output_averages(later_rows(rows, over), found)
    metrics = _finished(rows, config, found, sampling, ["slice_key", "model", "output", "metric", "sub_key", "__hidden"], small, changes=True)
    for item in plain:
        if isinstance(item.made, Derived) and item.made.stage == "intervals":
            if not options.intervals:
                raise ValueError(f"{item.name} needs intervals")
            bounds = F.struct("value", "sample_mean", "standard_error", "lower", "upper")
            wide_ = _side_by_side(metrics, ["slice_key", "slice", *(c for c in KEYS if c in metrics.columns)], item.made.needs, bounds)
            value = item.made.column({n: f"`{n}`" for n in item.made.needs}).cast("double").alias("value")
            own = wide_.select("slice_key", "slice", *(c for c in KEYS if c in metrics.columns), value, F.lit(item.name).alias("metric"), F.lit(private(item.name)).alias("__hidden"))
            metrics = metrics.unionByName(own, allowMissingColumns=True)
    metrics = metrics.where(~F.col("__hidden")).drop("__hidden")
    out["metrics"] = metrics
    if config.cross_slices:
        if small is not None:  # what is hidden is not told by differences either
            rows = slicing.hide_small(rows, small, options.min_slice_size).drop("error").where("value is not null")
        keys = ["baseline_key", "comparison_key", "model", "output", "metric", "sub_key", "__hidden"]
        out["cross_slices"] = _finished(crossed_rows(rows, config, found), config, found, sampling, keys).where(~F.col("__hidden")).drop("__hidden")
    if config.thresholds:
        out["validations"] = validation.validate(metrics, config.thresholds)
        out["missing_slices"] = validation.missing_slices(metrics, config.slices)
    return out


def _finished(rows: DataFrame, config: EvalConfig, found: Sequence[Item], sampling: Sampling, keys: list[str], small: DataFrame | None = None, changes: bool = False) -> DataFrame:
    """Results of samples as rows with intervals, if they are wanted, without columns that hold nothing here.

    ``changes``: with a baseline model also each result's change against it, with an interval of its own.
    """
    if small is not None:
        rows, keys = slicing.hide_small(rows, small, config.options.min_slice_size), [*keys, "error"]
    changes = changes and config.baseline is not None
    if changes:
        rows = model_differences(rows, config.baseline.name, [i.name for i in found if i.config.name in PAIRED])
    if sampling.kind is None:
        out = rows.where(F.col("__b") == confidence.WHOLE).select(*keys, "value", *(["change"] if changes else []))
    else:
        without = [i.name for i in found if not i.config.intervals or (i.made is not None and not i.made.intervals)]
        out = confidence.intervals(rows, sampling, keys, F.col("metric").isin(*without) if without else None)
        problem = F.col("problem") if small is None else F.coalesce("error", "problem")
        out = out.withColumn("error", problem).drop("problem")
    if "slice_key" in keys:
        out = out.withColumn("slice", slicing.slice_name(F.col("slice_key")))
    if not any(m.output for m in config.models):
        out = out.drop("output")
    return out if any(i.config.keyed for i in found) else out.drop("sub_key")


def pivoted(metrics: DataFrame, names: list[str]) -> DataFrame:
    """``slice, model`` and a column for each named metric."""
    return metrics.groupBy("slice", "model").pivot("metric", names).agg(F.first("value"))


def lookup(metrics: DataFrame, spec: slicing.SlicingSpec) -> DataFrame:
    """The results of the slices of one spec."""
    return metrics.where(slicing.applies(F.col("slice_key"), spec))
