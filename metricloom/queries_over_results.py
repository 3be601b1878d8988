"""Queries of metrics over metrics, over slices, classes, outputs and points of plots, with their intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.scalars import null_if_nan
from metricloom.operators.slicing import OVERALL, SlicingSpec, slice_name
from metricloom.plans.config import CrossSlicingSpec, EvalConfig, MetricConfig, ModelSpec, Options
from metricloom.plans.evaluate import evaluate
from metricloom.queries import AREAS, BASE, CELLS, CLASS_CELLS, HIST, JK, MODELS, ORDER_SETS, ORDERED, POINT_SQL, RANKED, SCORES, SLICED, SPECS, STEPS, TH200, cells, examples, query, scored

MODEL = (ModelSpec(MODELS["label"], "score", "l_quantity"),)
JACK = Options(intervals="jackknife", bucket=JK)


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(null_if_nan(F.col(name)), digits).alias(name)


def left_out(sums: dict[str, str], bucket: str = JK, source: str = SLICED, keys: str = "slice") -> str:
    """SQL: table ``o`` of all sums for each key and number of a left out bucket, -1 for none."""
    names = ", ".join(sums)
    on = " AND ".join(f"s.{k.strip()} IS NOT DISTINCT FROM t.{k.strip()}" for k in keys.split(","))
    return f"""{source}, s AS (SELECT {keys}, {bucket} AS b, {', '.join(f'{e} AS {n}' for n, e in sums.items())} FROM sl GROUP BY {keys}, b),
t AS (SELECT {keys}, {', '.join(f'sum({n}) AS {n}' for n in sums)} FROM s GROUP BY {keys}),
o AS (SELECT {', '.join(f't.{k.strip()}' for k in keys.split(','))}, i, {', '.join(f't.{n} - coalesce(s.{n}, 0) AS {n}' for n in sums)} FROM t CROSS JOIN range(-1, 20) r(i) LEFT JOIN s ON {on} AND s.b = i)"""


def with_error(value: str = "v", digits: int = 6) -> str:
    """SQL: the value of all rows and the jackknife's standard error of a column by ``i``."""
    return f"round(max(CASE WHEN i = -1 THEN {value} END), {digits}) AS value, round(CASE WHEN count(CASE WHEN i >= 0 THEN {value} END) = 20 THEN stddev_samp(CASE WHEN i >= 0 THEN {value} END) * 19 / sqrt(20) END, {digits}) AS standard_error"


RATE_SUMS = {"w": "sum(weight)", "wl": "sum(weight * label)"}
POOLED = "((x.wl + y.wl) / (x.w + y.w))"
CROSS_SQL = {
    "MeanLabel": "x.wl / x.w - y.wl / y.w", "RateRatio(MeanLabel)": "(y.wl / y.w) / (x.wl / x.w)", "ProportionTest": f"(x.wl / x.w - y.wl / y.w) / sqrt({POOLED} * (1 - {POOLED}) * (1 / x.w + 1 / y.w))",
    "Gap": "abs(x.wl / x.w - y.wl / y.w) * 100",
}


@query(
    "configured_cross_slices",
    f"WITH {left_out(RATE_SUMS)}, m AS (" + " UNION ALL ".join(f"SELECT x.slice AS baseline, y.slice AS comparison, '{n}' AS metric, x.i, {v} AS v FROM o x JOIN o y USING (i) WHERE x.slice = 'Overall' AND y.slice LIKE 'l_linestatus:%'" for n, v in CROSS_SQL.items()) + f") SELECT baseline, comparison, metric, {with_error()} FROM m GROUP BY ALL",
)
def configured_cross_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of two slices, over values and over both sides' sums, with intervals; what only helps them is not shown."""
    metrics = (MetricConfig("MeanLabel"), MetricConfig("RateRatio", {"metric": "MeanLabel"}), MetricConfig("ProportionTest"), MetricConfig("CrossExpression", {"sql": "abs(base.MeanLabel - other.MeanLabel) * 100", "needs": ["MeanLabel"]}, alias="Gap"))
    found = evaluate(examples(spark, sf_dir), EvalConfig(MODEL, SPECS, metrics, (CrossSlicingSpec(OVERALL, SPECS[1:2]),), options=JACK))["cross_slices"]
    return found.select(slice_name(F.col("baseline_key")).alias("baseline"), slice_name(F.col("comparison_key")).alias("comparison"), "metric", rounded("value"), rounded("standard_error"))


PARTS = f"WITH {SCORES}, x AS (SELECT label, vec_id, p, unnest([1, 4]) AS c FROM e), sl AS (SELECT 'Overall' AS slice, * FROM x UNION ALL SELECT 'part:' || (vec_id % 3), * FROM x)"


@query(
    "class_cross_slices",
    f"{PARTS}, v AS (SELECT slice, c, CAST(sum(CAST(c = label AND p[c + 1] > 0.1 AS INTEGER)) AS DOUBLE) / nullif(sum(CAST(p[c + 1] > 0.1 AS INTEGER)), 0) AS v FROM sl GROUP BY 1, 2) SELECT y.slice AS comparison, 'class:' || x.c AS sub_key, round(x.v - y.v, 6) AS value FROM v x JOIN v y USING (c) WHERE x.slice = 'Overall' AND y.slice <> 'Overall'",
)
def class_cross_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of two classes between slices: a class meets itself only."""
    df = scored(spark, sf_dir).withColumn("part", F.col("vec_id") % 3)
    config = EvalConfig((ModelSpec("hot", "prediction"),), (OVERALL, SlicingSpec(("part",))), (MetricConfig("Precision", {"threshold": 0.1}, (1, 4)),), (CrossSlicingSpec(OVERALL),))
    return evaluate(df, config)["cross_slices"].select(slice_name(F.col("comparison_key")).alias("comparison"), "sub_key", rounded("value"))


F2 = "5 * p * r / nullif(4 * p + r, 0)"
DERIVED_SQL = {"MyF1": "2 * p * r / nullif(p + r, 0)", "Gap": "2 * p * r / nullif(p + r, 0) - tp / (tp + fp + fn)", "F2": F2, "ThreatScore": "tp / (tp + fp + fn)", "AUC": "a", "Gini": "2 * a - 1"}


@query(
    "configured_derived",
    f"WITH {HIST}{TH200}{CELLS}{STEPS}, a AS (SELECT slice, coalesce(sum(CASE WHEN tp2 IS NOT NULL THEN {AREAS['roc_interpolation']} END), 0) AS a FROM p GROUP BY slice), c AS (SELECT slice, {cells()} FROM sl GROUP BY slice), v AS (SELECT *, {POINT_SQL['Precision']} AS p, {POINT_SQL['Recall']} AS r FROM c JOIN a USING (slice)) "
    + " UNION ALL ".join(f"SELECT slice, '{n}' AS metric, round({v}, 6) AS value FROM v" for n, v in DERIVED_SQL.items()),
)
def configured_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over metrics: over hidden ones, over derived ones, over those that they bring along, over a curve's."""
    metrics = (
        MetricConfig("Expression", {"sql": "MyF1 - `ThreatScore`", "needs": ["MyF1", "ThreatScore"]}, alias="Gap"), MetricConfig("Expression", {"sql": "2 * _p * _r / (_p + _r)", "needs": ["_p", "_r"]}, alias="MyF1"), MetricConfig("Precision", alias="_p"),
        MetricConfig("Recall", alias="_r"), MetricConfig("FBeta", {"beta": 2}), MetricConfig("ThreatScore"), MetricConfig("AUC"), MetricConfig("Expression", {"sql": "2 * AUC - 1", "needs": ["AUC"]}, alias="Gini"),
    )
    return evaluate(examples(spark, sf_dir), EvalConfig(MODEL, SPECS, metrics))["metrics"].select("slice", "metric", rounded("value"))


CELL_SUMS = {n: e.split(" AS ")[0] for n, e in zip(("tp", "fp", "fn", "tn"), cells().split(", sum"), strict=True)}
CELL_SUMS = {n: e if e.startswith("sum") else f"sum{e}" for n, e in CELL_SUMS.items()}


@query(
    "derived_intervals",
    f"WITH {left_out(CELL_SUMS)}, v AS (SELECT slice, i, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN 5 * tp / nullif(5 * tp + 4 * fn + fp, 0) END AS f, tp / nullif(tp + fp, 0) AS p FROM o), x AS (SELECT slice, max(CASE WHEN i = -1 THEN f END) AS f, stddev_samp(CASE WHEN i >= 0 THEN f END) * 19 / sqrt(20) AS e, max(CASE WHEN i = -1 THEN p END) AS p FROM v GROUP BY slice) "
    "SELECT slice, 'F2' AS metric, round(f, 6) AS value, round(e, 6) AS standard_error FROM x UNION ALL SELECT slice, 'RelativeError(F2)', round(2.093024054408263 * e / nullif(f, 0), 6), NULL FROM x UNION ALL SELECT slice, 'Precision', round(p, 6), NULL FROM x",
)
def derived_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric over metrics in each sample, one over its interval, and one that was asked to have none."""
    metrics = (MetricConfig("FBeta", {"beta": 2}), MetricConfig("RelativeError", {"metric": "F2"}), MetricConfig("Precision", intervals=False))
    return evaluate(examples(spark, sf_dir), EvalConfig(MODEL, SPECS, metrics, options=JACK))["metrics"].select("slice", "metric", rounded("value"), rounded("standard_error"))


TH20 = ", th AS (SELECT -1e-6 AS t UNION ALL SELECT j / CAST(20 AS DOUBLE) FROM range(21) r(j))"
BUCKET = "CAST(CASE WHEN prediction >= 1 THEN 10001 WHEN prediction < 0 THEN 0 ELSE floor(prediction * 10000) + 1 END AS BIGINT)"
UP = f"({BUCKET} > 0 AND ({BUCKET} - 1) / CAST(10000 AS DOUBLE) + 1e-12 >= t)"
UP_SUMS = {"tp": f"sum(CASE WHEN {UP} THEN weight * label ELSE 0 END)", "fp": f"sum(CASE WHEN {UP} THEN weight * (1 - label) ELSE 0 END)", "fn": f"sum(CASE WHEN {UP} THEN 0 ELSE weight * label END)"}
PLOT_SOURCE = SLICED.replace(", sl AS", ", s0 AS") + f"{TH20}, sl AS (SELECT s0.*, t FROM s0, th WHERE slice NOT LIKE '%_X_%')"


@query(
    "plot_intervals",
    f"WITH {left_out(UP_SUMS, source=PLOT_SOURCE, keys='slice, t')}, m AS (SELECT slice, t, 'tp' AS measure, i, tp AS v FROM o UNION ALL SELECT slice, t, 'precision', i, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END FROM o) SELECT slice, round(t, 8) AS threshold, measure, {with_error(digits=4)} FROM m GROUP BY slice, t, measure",
)
def plot_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jackknife of each point of a plot."""
    found = evaluate(examples(spark, sf_dir), EvalConfig(MODEL, SPECS[:2], (MetricConfig("ConfusionMatrixPlot", {"num_thresholds": 20}),), options=JACK))["plots"]
    kept = found.where(F.col("measure").isin("tp", "precision"))
    return kept.select("slice", F.round(F.col("point")[0]["value"], 8).alias("threshold"), "measure", rounded("value", 4), rounded("standard_error", 4))


CLASS_HIST = f"{SCORES}, y AS (SELECT vec_id, CAST(c = label AS DOUBLE) AS label, CAST(1 AS DOUBLE) AS weight, p[c + 1] AS prediction, 'class:' || c AS slice FROM (SELECT *, unnest([1, 4, 7]) AS c FROM e)), b AS (SELECT slice, {BUCKET} AS bucket, sum(weight) AS w, sum(weight * label) AS wl FROM y GROUP BY 1, 2)"


@query(
    "configured_class_curves",
    f"WITH {CLASS_HIST}{TH200}{CELLS}{STEPS}, a AS (SELECT slice, coalesce(sum(CASE WHEN tp2 IS NOT NULL THEN {AREAS['roc_interpolation']} END), 0) AS a, coalesce(sum(CASE WHEN tp2 IS NOT NULL THEN {AREAS['roc_majoring']} END), 0) AS b, max(tp + fn) AS n FROM p GROUP BY slice) "
    "SELECT slice AS sub_key, 'AUC' AS metric, round(a, 6) AS value FROM a WHERE slice <> 'class:7' UNION ALL SELECT slice, 'AUC[method=majoring]', round(b, 6) FROM a WHERE slice <> 'class:7' UNION ALL SELECT 'macro', 'AUC', round(avg(a), 6) FROM a UNION ALL SELECT 'weighted_macro', 'AUC', round(sum(a * n) / sum(n), 6) FROM a",
)
def configured_class_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of single classes, drawn in two ways, and their averages over classes."""
    metrics = (MetricConfig("AUC", class_ids=(1, 4)), MetricConfig("AUC", {"method": "majoring"}, (1, 4)), MetricConfig("AUC", class_ids=(1, 4, 7), average="macro"), MetricConfig("AUC", class_ids=(1, 4, 7), average="weighted_macro"))
    return evaluate(scored(spark, sf_dir), EvalConfig((ModelSpec("hot", "prediction"),), (OVERALL,), metrics))["metrics"].select("sub_key", "metric", rounded("value"))


CLASS_ROWS = f"{SCORES}, sl AS (SELECT vec_id, c, CAST(c = label AS DOUBLE) AS l, CAST(p[c + 1] > 0.1 AS DOUBLE) AS u FROM (SELECT *, unnest(range(0, 10)) AS c FROM e))"


@query(
    "configured_class_intervals",
    f"WITH {left_out({'tp': 'sum(l * u)', 'up': 'sum(u)', 'n': 'sum(l)'}, 'vec_id % 20', CLASS_ROWS, 'c')}, m AS (SELECT 'class:' || c AS sub_key, 'Precision@0.1' AS metric, i, tp / nullif(up, 0) AS v FROM o WHERE c IN (1, 4) UNION ALL SELECT 'macro', 'Recall@0.1', i, avg(tp / n) FROM o GROUP BY i UNION ALL SELECT 'micro', 'Recall@0.1', i, sum(tp) / sum(n) FROM o GROUP BY i UNION ALL SELECT 'weighted_macro', 'Recall@0.1', i, sum(tp / n * n) / sum(n) FROM o GROUP BY i) SELECT sub_key, metric, {with_error()} FROM m GROUP BY ALL",
)
def configured_class_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of single classes and of averages over classes: each sample is averaged anew."""
    ten, at = tuple(range(10)), {"threshold": 0.1}
    metrics = (MetricConfig("Precision", at, (1, 4)), *(MetricConfig("Recall", at, ten, average=how) for how in ("macro", "micro", "weighted_macro")))
    config = EvalConfig((ModelSpec("hot", "prediction"),), (OVERALL,), metrics, options=Options(intervals="jackknife", bucket="vec_id % 20"))
    return evaluate(scored(spark, sf_dir), config)["metrics"].select("sub_key", "metric", rounded("value"), rounded("standard_error"))


@query(
    "ranking_intervals",
    f"WITH {RANKED}, sl AS (SELECT l_orderkey, sum(CASE WHEN n <= 3 THEN l_quantity / log2(n + 1) ELSE 0 END) / sum(CASE WHEN m <= 3 THEN l_quantity / log2(m + 1) ELSE 0 END) AS v, CAST(min(CASE WHEN label > 0 THEN n END) AS DOUBLE) AS f, 1 AS g FROM r GROUP BY l_orderkey), "
    + left_out({"v": "sum(v)", "n": "CAST(count(v) AS DOUBLE)", "f": "coalesce(sum(f), 0)", "k": "CAST(count(f) AS DOUBLE)"}, "l_orderkey % 20", "z AS (SELECT 1)", "g")
    + f", m AS (SELECT 'NDCG@3' AS metric, i, v / n AS v FROM o UNION ALL SELECT 'MinLabelPosition', i, f / k FROM o) SELECT metric, {with_error()} FROM m GROUP BY metric",
)
def ranking_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jackknife of rankings leaves out whole queries."""
    metrics = (MetricConfig("NDCG", {"query": "l_orderkey", "gain": "l_quantity", "ks": [3], "order": list(ORDERED)}), MetricConfig("MinLabelPosition", {"query": "l_orderkey", "order": list(ORDERED)}))
    config = EvalConfig((ModelSpec(MODELS["label"], "score"),), (OVERALL,), metrics, options=Options(intervals="jackknife", bucket="l_orderkey % 20"))
    return evaluate(examples(spark, sf_dir), config)["metrics"].select("metric", rounded("value"), rounded("standard_error"))


OUTPUT_SQL = " UNION ALL ".join(f"SELECT slice, '{o}' AS output, {l} AS l, {p} AS p, weight FROM sl" for o, l, p in (("returned", "label", "prediction"), ("open", "CAST(l_linestatus = 'O' AS DOUBLE)", "other")))


@query(
    "several_outputs",
    f"WITH {SLICED}, u AS ({OUTPUT_SQL}), v AS (SELECT slice, output, sum(weight * l) / sum(weight) AS m, sum(CASE WHEN p > 0.5 THEN weight * l ELSE 0 END) / sum(CASE WHEN p > 0.5 THEN weight ELSE 0 END) AS p FROM u GROUP BY 1, 2) SELECT slice, output, 'MeanLabel' AS metric, round(m, 6) AS value FROM v UNION ALL SELECT slice, output, 'Precision', round(p, 6) FROM v UNION ALL SELECT slice, 'average', 'Precision', round(sum(p * CASE WHEN output = 'open' THEN 3 ELSE 1 END) / 4, 6) FROM v GROUP BY slice",
)
def several_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model with two outputs: each one's values, and an average with weights, from one aggregation."""
    outputs = (ModelSpec(MODELS["label"], "score", "l_quantity", output="returned"), ModelSpec("CAST(l_linestatus = 'O' AS DOUBLE)", "other", "l_quantity", output="open"))
    config = EvalConfig(outputs, SPECS, (MetricConfig("MeanLabel"), MetricConfig("Precision", output_weights={"returned": 1, "open": 3})))
    return evaluate(examples(spark, sf_dir), config)["metrics"].select("slice", "output", "metric", rounded("value"))


@query("configured_sets", f"WITH {ORDER_SETS} SELECT 'SetMatchPrecision@0.3' AS metric, round(sum(CASE WHEN l = 1 AND s = 1 AND p > 0.3 THEN 1.0 ELSE 0 END) / sum(CASE WHEN s = 1 AND p > 0.3 THEN 1.0 ELSE 0 END), 6) AS value FROM o UNION ALL SELECT 'SetMatchRecall@0.3', round(sum(CASE WHEN l = 1 AND s = 1 AND p > 0.3 THEN 1.0 ELSE 0 END) / sum(CASE WHEN l = 1 THEN 1.0 ELSE 0 END), 6) FROM o")
def configured_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of sets of labels by one configuration."""
    items = examples(spark, sf_dir).groupBy("l_orderkey", (F.col("l_suppkey") % 5).alias("item")).agg(F.max("label").alias("l"), F.max("prediction").alias("p"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("s"))
    orders = items.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l") == 1, F.col("item"))).alias("labels"), F.collect_list(F.when(F.col("s") == 1, F.struct("item", "p"))).alias("z"))
    config = EvalConfig((ModelSpec("labels", "named_struct('classes', z.item, 'scores', z.p)"),), (OVERALL,), tuple(MetricConfig(n, {"threshold": 0.3}) for n in ("SetMatchPrecision", "SetMatchRecall")))
    return evaluate(orders, config)["metrics"].select("metric", rounded("value"))


@query("configured_plots", f"WITH {CLASS_CELLS}, t AS (SELECT CAST(0.1 AS DOUBLE) AS threshold) SELECT 'MultiClassConfusionMatrixPlot' AS metric, CAST(label AS DOUBLE) AS actual, CAST(CASE WHEN list_max(p) > threshold THEN list_position(p, list_max(p)) - 1 ELSE -1 END AS DOUBLE) AS predicted, 'w' AS measure, CAST(count(*) AS DOUBLE) AS value FROM e, t GROUP BY 2, 3 UNION ALL SELECT 'MultiLabelConfusionMatrixPlot', CAST(label AS DOUBLE), CAST(c AS DOUBLE), 'fp', CAST(sum(CAST(c <> label AND p[c + 1] > 0.1 AS INTEGER)) AS DOUBLE) FROM x GROUP BY 2, 3")
def configured_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of cells over classes by one configuration."""
    config = EvalConfig((ModelSpec("hot", "prediction"),), (OVERALL,), tuple(MetricConfig(n, {"thresholds": [0.1]}) for n in ("MultiClassConfusionMatrixPlot", "MultiLabelConfusionMatrixPlot")))
    found = evaluate(scored(spark, sf_dir), config)["plots"].where(F.col("measure").isin("w", "fp"))
    return found.select("metric", F.col("point")[1]["value"].alias("actual"), F.col("point")[2]["value"].alias("predicted"), "measure", "value")


# --- rows behind results, own metrics, counts and parts of rows ---------------------------------------------------------

IDS = "l_orderkey * 100 + l_linenumber"
SHORT = SLICED.split("\n  UNION ALL SELECT 'l_linestatus_X")[0] + ")"
CELL_AT = "CASE WHEN prediction > t THEN CASE WHEN label > 0 THEN 'tp' ELSE 'fp' END ELSE CASE WHEN label > 0 THEN 'fn' ELSE 'tn' END END"


@query(
    "cell_examples",
    f"WITH {SHORT}, x AS (SELECT slice, t, {CELL_AT} AS cell, {IDS} AS id, ({IDS}) * 7919 % 10007 AS o FROM sl, (SELECT CAST(unnest([0.25, 0.5, 0.9]) AS DOUBLE) AS t)), r AS (SELECT DISTINCT slice, t, cell, id, dense_rank() OVER (PARTITION BY slice, t, cell ORDER BY o, id) AS n FROM x) SELECT slice, t AS threshold, cell, CAST(n - 1 AS INTEGER) AS i, id FROM r WHERE n <= 7",
)
def cell_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of rows in each cell of a confusion matrix, the first of an order."""
    from metricloom.operators import curves

    df = examples(spark, sf_dir).withColumn("id", F.expr(IDS))
    found = curves.cell_examples(df, (0.25, 0.5, 0.9), "id", 7, SPECS[:2], order=F.col("id") * 7919 % 10007)
    return found.select(slice_name(F.col("slice_key")).alias("slice"), "threshold", "cell", F.posexplode("ids").alias("i", "id"))


CENTRED = f"WITH {SLICED}, m AS (SELECT slice, sum(weight) AS n, sum(weight * prediction) / sum(weight) AS a, sum(weight * l_discount) / sum(weight) AS b FROM sl GROUP BY slice), c AS (SELECT slice, n, a, b, sum(weight * (prediction - a) ** 2) AS p, sum(weight * (l_discount - b) ** 2) AS q, sum(weight * (prediction - a) * (l_discount - b)) AS r FROM sl JOIN m USING (slice) GROUP BY ALL)"
PRICE_STEPS = "h AS (SELECT slice, least(floor(l_extendedprice / 200000 * 1000), 999) AS g, sum(weight) AS w FROM sl GROUP BY 1, 2), k AS (SELECT slice, g, sum(w) OVER (PARTITION BY slice ORDER BY g) AS below, sum(w) OVER (PARTITION BY slice) AS total FROM h)"


@query(
    "own_accumulators",
    f"{CENTRED}, {PRICE_STEPS} SELECT slice, 'moments/mean_x' AS metric, round(a, 6) AS value FROM c UNION ALL SELECT slice, 'moments/mean_y', round(b, 6) FROM c UNION ALL SELECT slice, 'moments/variance_x', round(p / n, 6) FROM c UNION ALL SELECT slice, 'moments/squared_correlation', round(r * r / (p * q), 6) FROM c "
    + " ".join(f"UNION ALL SELECT slice, 'price/{q}', min(g) * CAST(200 AS DOUBLE) FROM k WHERE below >= {q} * total GROUP BY slice" for q in (0.5, 0.9)),
)
def own_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics written in NumPy, over one pass: moments and quantiles."""
    from metricloom.operators.accumulators import Quantiles, WeightedMoments, accumulated

    columns = {"x": F.col("prediction"), "y": F.col("l_discount"), "price": F.col("l_extendedprice"), "w": F.col("weight")}
    own = {"moments": WeightedMoments("x", "y", "w"), "price": Quantiles("price", "w", 0, 200_000, 1_000, (0.5, 0.9))}
    found = accumulated(examples(spark, sf_dir), columns, own, SPECS)
    return found.select(slice_name(F.col("slice_key")).alias("slice"), "metric", rounded("value"))


@query(
    "observed_counts",
    f"WITH {SLICED}, v AS (SELECT count(DISTINCT slice) AS s FROM sl) SELECT 'rows' AS counter, count(*) AS value FROM lineitem UNION ALL SELECT 'bytes', CAST(sum(strlen(l_returnflag) + strlen(l_linestatus) + 16) AS BIGINT) FROM lineitem UNION ALL SELECT 'slices', s FROM v UNION ALL SELECT 'values', 2 * s FROM v UNION ALL SELECT 'undefined', count(*) FROM (SELECT slice FROM sl GROUP BY slice HAVING sum(label) = 0)",
)
def observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes that an evaluation read, and slices and values that it made, counted while it ran."""
    from metricloom.plans.counters import counted

    df = examples(spark, sf_dir).select("l_returnflag", "l_linestatus", "l_quantity", "score")
    results, counters = counted(df, EvalConfig(MODEL, SPECS, (MetricConfig("MeanLabel"), MetricConfig("Recall"))))
    results["metrics"].write.format("noop").mode("overwrite").save()  # the results themselves would be written here
    return spark.createDataFrame(sorted(counters.get().items()), "counter string, value long")


@query(
    "parts_of_rows",
    "SELECT l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, round(sum(l_discount), 4) AS discount, CAST(0 AS BIGINT) AS taxes, CAST(sum(CAST(l_orderkey % 2 = 0 AS INTEGER)) AS BIGINT) AS even, CAST(sum(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS flagged, CAST(2 AS BIGINT) AS left_fields FROM lineitem GROUP BY l_linestatus",
)
def parts_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of nested rows by paths: kept, put, left out and read."""
    from metricloom.functions import extracts
    from metricloom.queries import table

    nested = table(spark, sf_dir, "lineitem").select(
        "l_linestatus",
        F.struct(F.struct(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line")).alias("order"), F.create_map(F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax")).alias("rates")).alias("features"),
        F.array(F.struct(F.lit("returned").alias("name"), (F.col("l_returnflag") == "R").alias("value"), F.col("l_shipdate").alias("at"))).alias("flags"),
    )
    kept = extracts.include(nested, extracts.merged(["l_linestatus", "features.order.key"], ["features.rates.discount", "flags.name", "flags.value"]))
    put = extracts.put(kept, "features.order.even", extracts.get(kept, "features.order.key") % 2 == 0)
    left = extracts.exclude(put, ["flags.name"])
    part = lambda path: extracts.get(left, path)
    return left.groupBy("l_linestatus").agg(
        F.count("*").alias("n"), F.sum(part("features.order.key")).alias("keys"), F.round(F.sum(part("features.rates.discount")), 4).alias("discount"), F.count(part("features.rates.tax")).alias("taxes"), F.sum(part("features.order.even").cast("long")).alias("even"),
        F.sum(part("flags.value")[0].cast("long")).alias("flagged"), F.lit(len(left.schema["features"].dataType["order"].dataType.fields)).cast("long").alias("left_fields"),
    )


@query(
    "staged_verdict",
    f"WITH {SLICED}, s AS (SELECT slice, sum(weight * label) / sum(weight) AS v FROM sl GROUP BY slice), o AS (SELECT v BETWEEN 0.2 AND 0.5 AS ok FROM s WHERE slice LIKE 'l_linestatus:%' UNION ALL SELECT v > 0.9 FROM s WHERE slice = 'Overall') SELECT 'verdict' AS result, false AS ok, CAST(count(CASE WHEN NOT ok THEN 1 END) AS BIGINT) AS failures, CAST(1 AS BIGINT) AS missing FROM o UNION ALL SELECT 'own', true, CAST(count(*) AS BIGINT), 0 FROM (SELECT DISTINCT slice FROM sl)",
)
def staged_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation in stages with a user's one; a slice that is wanted and not there is counted."""
    from metricloom.operators.validation import Threshold
    from metricloom.plans.stages import Stage, run

    specs = (*SPECS, SlicingSpec(("l_linestatus",), {"l_returnflag": "none"}))
    config = EvalConfig(MODEL, specs, (MetricConfig("MeanLabel"),), thresholds=(Threshold("MeanLabel", 0.2, 0.5, spec=SPECS[1]), Threshold("MeanLabel", 0.9)))
    own = Stage("own", lambda df, config, results: {"own": results["metrics"].agg(F.count("*").alias("failures"))}, run_after=("metrics",))
    out = run(examples(spark, sf_dir), config, (own,))
    return out["verdict"].select(F.lit("verdict").alias("result"), "ok", "failures", "missing").unionAll(out["own"].select(F.lit("own"), F.lit(True), "failures", F.lit(0).cast("long")))


@query(
    "configured_attributions",
    f"WITH {left_out({'d': 'sum(weight * (l_discount - 0.05))', 'x': 'sum(weight * (0.04 - l_tax))', 'w': 'sum(weight)'})}, m AS (SELECT slice, 'TotalAttributions' AS metric, 'discount' AS feature, i, d AS v FROM o UNION ALL SELECT slice, 'TotalAttributions', 'tax', i, x FROM o UNION ALL SELECT slice, 'MeanAttributions', 'discount', i, d / w FROM o UNION ALL SELECT slice, 'MeanAttributions', 'tax', i, x / w FROM o) SELECT slice, metric, feature, {with_error(digits=4)} FROM m GROUP BY ALL",
)
def configured_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions by feature with intervals, by one configuration."""
    df = examples(spark, sf_dir).withColumn("a", F.create_map(F.lit("discount"), F.col("l_discount") - 0.05, F.lit("tax"), 0.04 - F.col("l_tax")))
    metrics = tuple(MetricConfig(n, {"column": "a"}) for n in ("TotalAttributions", "MeanAttributions"))
    found = evaluate(df, EvalConfig(MODEL, SPECS, metrics, options=JACK))["attributions"]
    return found.select("slice", "metric", "feature", rounded("value", 4), rounded("standard_error", 4))


@query("configured_segmentation", "WITH p AS (SELECT CAST(l_quantity AS BIGINT) % 3 AS t, l_partkey % 3 AS p FROM lineitem), c AS (SELECT unnest([0, 1, 2]) AS c) SELECT CAST(c AS DOUBLE) AS class_id, CAST(sum(CAST(t = c AND p = c AS INTEGER)) AS DOUBLE) AS tp, CAST(sum(CAST(t <> c AND p = c AND t <> 0 AS INTEGER)) AS DOUBLE) AS fp, CAST(sum(CAST(t = c AND p <> c AS INTEGER)) AS DOUBLE) AS fn, CAST(sum(CAST(t <> c AND p <> c AND t <> 0 AS INTEGER)) AS DOUBLE) AS tn FROM p, c GROUP BY c")
def configured_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of pixels by configuration, as a table of points."""
    from metricloom.plans.tables import points
    from metricloom.queries import table

    images = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_quantity").cast("long") % 3).cast("int")).alias("truth"), F.collect_list((F.col("l_partkey") % 3).cast("int")).alias("predicted"))
    config = EvalConfig((ModelSpec("truth", "predicted"),), (OVERALL,), (MetricConfig("SemanticSegmentationConfusionMatrix", {"classes": [0, 1, 2], "ignore": 0}),))
    return points(evaluate(images, config)["plots"]).select("class_id", "tp", "fp", "fn", "tn")


@query("results_by_features", f"WITH {SLICED} SELECT 'Overall' AS slice, NULL AS status, NULL AS flag, round(sum(weight * label) / sum(weight), 6) AS value FROM base UNION ALL SELECT 'l_linestatus:' || l_linestatus, l_linestatus, NULL, round(sum(weight * label) / sum(weight), 6) FROM base GROUP BY l_linestatus UNION ALL SELECT 'l_linestatus_X_l_returnflag:' || l_linestatus || '_X_' || l_returnflag, l_linestatus, l_returnflag, round(sum(weight * label) / sum(weight), 6) FROM base GROUP BY l_linestatus, l_returnflag")
def results_by_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as a flat table with a column for each feature that slices have."""
    from metricloom.plans.tables import by_features, lookup

    found = evaluate(examples(spark, sf_dir), EvalConfig(MODEL, SPECS, (MetricConfig("MeanLabel"), MetricConfig("ExampleCount"))))["metrics"]
    flat = by_features(lookup(found, metric="MeanLabel"), ("l_linestatus", "l_returnflag"))
    return flat.select("slice", F.col("`slice.l_linestatus`").alias("status"), F.col("`slice.l_returnflag`").alias("flag"), rounded("value"))


@query(
    "change_intervals",
    f"WITH {left_out({'w': 'sum(weight)', 'wp': 'sum(weight * prediction)', 'wo': 'sum(weight * other)'})}, m AS (SELECT slice, i, wp / w AS n, wp / w - wo / w AS c FROM o) SELECT slice, round(max(CASE WHEN i = -1 THEN n END), 6) AS value, round(max(CASE WHEN i = -1 THEN c END), 6) AS change, round(stddev_samp(CASE WHEN i >= 0 THEN c END) * 19 / sqrt(20), 6) AS change_error FROM m GROUP BY slice",
)
def change_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change between two models has an interval of its own: both models lack the same rows in each sample."""
    from metricloom.queries import TWO

    found = evaluate(examples(spark, sf_dir), EvalConfig(TWO, SPECS, (MetricConfig("MeanPrediction"),), options=JACK))["metrics"]
    return found.where("model = 'new'").select("slice", rounded("value"), rounded("change"), rounded("change_error"))
