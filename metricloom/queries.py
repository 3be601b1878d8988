"""Queries over the tables, each with the SQL that must give the same rows.

``lineitem`` stands for scored examples: the label is whether the item came back, the prediction a number by integer
arithmetic that any engine gives alike, a second model likewise, the weight the quantity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions import inputs
from metricloom.functions.scalars import null_if_nan
from metricloom.operators import confidence, curves, detection, multiclass, ranking, slicing, textscores, validation
from metricloom.operators.metrics import POINTS, Row, make
from metricloom.operators.slicing import OVERALL, SlicingSpec
from metricloom.plans.config import EvalConfig, MetricConfig, ModelSpec, Options
from metricloom.plans.evaluate import binarized, evaluate, wide
from metricloom.streaming.incremental import running_metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SPECS = (OVERALL, SlicingSpec(("l_linestatus",)), SlicingSpec(("l_linestatus", "l_returnflag")))
MODELS = {"label": "CAST(l_returnflag = 'R' AS DOUBLE)", "prediction": "score", "weight": "l_quantity"}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = lambda a, b: (F.expr(a) * 7919 + F.expr(b) * 104729 + F.col("l_linenumber")) % 10007 / F.lit(10007.0)
    return table(spark, sf_dir, "lineitem").withColumns(
        {"score": score("l_orderkey", "l_partkey"), "other": score("l_suppkey", "l_orderkey"), "label": F.expr(MODELS["label"]), "weight": F.col("l_quantity")}
    ).withColumn("prediction", F.col("score"))


BASE = """base AS (
  SELECT *, CAST(l_returnflag = 'R' AS DOUBLE) AS label, l_quantity AS weight,
         CAST((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS prediction,
         CAST((l_suppkey * 7919 + l_orderkey * 104729 + l_linenumber) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS other
  FROM lineitem)"""
SLICED = f"""{BASE}, sl AS (
  SELECT 'Overall' AS slice, * FROM base
  UNION ALL SELECT 'l_linestatus:' || l_linestatus, * FROM base
  UNION ALL SELECT 'l_linestatus_X_l_returnflag:' || l_linestatus || '_X_' || l_returnflag, * FROM base)"""


def shown(df: DataFrame, names: list[str], digits: int = 6, keep: tuple[str | Column, ...] = ()) -> DataFrame:
    """The slice's name and rounded values; NaN is null."""
    return df.select(slicing.slice_name(F.col("slice_key")).alias("slice"), *keep, *(F.round(null_if_nan(F.col(f"`{n}`").cast("double")), digits).alias(n) for n in names))


def per_slice(metrics: list[MetricConfig], label: str = MODELS["label"], prediction: str = "score", weight: str | None = "l_quantity", digits: int = 6, specs=SPECS):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = EvalConfig((ModelSpec(label, prediction, weight),), specs, tuple(metrics))
        return shown(wide(examples(spark, sf_dir), config), [make(m.name, **m.params).name for m in metrics], digits)

    return run


def ratios(sums: str, values: dict[str, str], digits: int = 6, source: str = SLICED) -> str:
    """SQL: sums by slice, then rounded values over them."""
    return f"WITH {source}, s AS (SELECT slice, {sums} FROM sl GROUP BY slice) SELECT slice, " + ", ".join(f'round({v}, {digits}) AS "{n}"' for n, v in values.items()) + " FROM s"


def over(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"


# --- sums ---------------------------------------------------------------------------------------------------------------

QUERIES["means_and_calibration"] = per_slice([MetricConfig(n) for n in ("ExampleCount", "MeanLabel", "MeanPrediction", "Calibration")] + [MetricConfig("Mean", {"column": "l_extendedprice"})], digits=4)
ORACLE_SQL["means_and_calibration"] = ratios(
    "sum(weight) AS w, sum(weight * label) AS wl, sum(weight * prediction) AS wp, sum(weight * l_extendedprice) AS wx",
    {"ExampleCount": "w", "MeanLabel": over("wl", "w"), "MeanPrediction": over("wp", "w"), "Calibration": over("wp", "wl"), "Mean(l_extendedprice)": over("wx", "w")}, 4,
)

QUERIES["unweighted_counts"] = per_slice([MetricConfig("ExampleCount"), MetricConfig("MeanLabel"), MetricConfig("Accuracy")], weight=None)
ORACLE_SQL["unweighted_counts"] = ratios("CAST(count(*) AS DOUBLE) AS w, sum(label) AS wl, sum(CAST(label = prediction AS DOUBLE)) AS e", {"ExampleCount": "w", "MeanLabel": over("wl", "w"), "Accuracy": over("e", "w")})

QUERIES["regression_errors"] = per_slice([MetricConfig(n) for n in ("MeanAbsoluteError", "MeanSquaredError", "MeanAbsolutePercentageError", "MeanSquaredLogarithmicError")], "l_extendedprice / 1000", "l_quantity", "l_linenumber")
ORACLE_SQL["regression_errors"] = ratios(
    "CAST(sum(l_linenumber) AS DOUBLE) AS w, sum(l_linenumber * abs(l_extendedprice / 1000 - l_quantity)) AS a, sum(l_linenumber * (l_extendedprice / 1000 - l_quantity) ** 2) AS s, "
    "sum(CASE WHEN l_extendedprice <> 0 THEN l_linenumber * 100 * abs((l_extendedprice / 1000 - l_quantity) / (l_extendedprice / 1000)) ELSE 0 END) AS r, "
    "sum(CASE WHEN l_extendedprice <> 0 THEN l_linenumber ELSE 0 END) AS rw, sum(l_linenumber * (ln(l_extendedprice / 1000 + 1) - ln(l_quantity + 1)) ** 2) AS g",
    {"MeanAbsoluteError": "a / w", "MeanSquaredError": "s / w", "MeanAbsolutePercentageError": over("r", "rw"), "MeanSquaredLogarithmicError": "g / w"},
)

LOSSES = "sum(weight) AS w, sum(weight * -(label * ln(CASE WHEN label > 0 THEN p ELSE 1 END) + (1 - label) * ln(CASE WHEN label < 1 THEN 1 - p ELSE 1 END))) AS e, sum(weight * (greatest(prediction, 0) - prediction * (label * 0.9 + 0.05) + ln(1 + exp(-abs(prediction))))) AS g"


@query("losses", f"WITH {SLICED}, q AS (SELECT *, (prediction * 0.98 + 0.01) AS p FROM sl), s AS (SELECT slice, {LOSSES} FROM q GROUP BY slice) SELECT slice, round(e / w, 6) AS \"BinaryCrossEntropy\", round(g / w, 6) AS smoothed FROM s")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = examples(spark, sf_dir)
    one = wide(df, EvalConfig((ModelSpec(MODELS["label"], "score * 0.98D + 0.01D", "l_quantity"),), SPECS, (MetricConfig("BinaryCrossEntropy"),)))
    two = wide(df, EvalConfig((ModelSpec(MODELS["label"], "score", "l_quantity"),), SPECS, (MetricConfig("BinaryCrossEntropy", {"from_logits": True, "label_smoothing": 0.1}),)))
    return shown(one.join(two.withColumnRenamed("BinaryCrossEntropy", "smoothed"), "slice_key"), ["BinaryCrossEntropy", "smoothed"])


QUERIES["correlation"] = per_slice([MetricConfig(n) for n in ("SquaredPearsonCorrelation", "CoefficientOfDiscrimination", "RelativeCoefficientOfDiscrimination")])
ORACLE_SQL["correlation"] = ratios(
    "sum(weight) AS w, sum(weight * label) AS wl, sum(weight * prediction) AS wp, sum(weight * label * label) AS wll, sum(weight * prediction * prediction) AS wpp, sum(weight * label * prediction) AS wlp",
    {
        "SquaredPearsonCorrelation": "CASE WHEN (wll - wl * wl / w) * (wpp - wp * wp / w) > 0 THEN (wlp - wl * wp / w) ** 2 / ((wll - wl * wl / w) * (wpp - wp * wp / w)) END",
        "CoefficientOfDiscrimination": "CASE WHEN wl > 0 AND w - wl > 0 THEN wlp / wl - (wp - wlp) / (w - wl) END",
        "RelativeCoefficientOfDiscrimination": "CASE WHEN wl > 0 AND w - wl > 0 AND wp - wlp > 0 THEN (wlp / wl) / ((wp - wlp) / (w - wl)) END",
    },
)

QUERIES["exact_match"] = per_slice([MetricConfig("ExactMatch")], "l_linestatus", "l_returnflag", specs=SPECS[:2])
ORACLE_SQL["exact_match"] = ratios("sum(weight) AS w, sum(CASE WHEN l_linestatus = l_returnflag THEN weight ELSE 0 END) AS e", {"ExactMatch": "e / w"}, source=SLICED.split("\n  UNION ALL SELECT 'l_linestatus_X")[0] + ")")


@query("exact_match_json", "SELECT event_type AS t, round(avg(CAST(json(props) = json(props) AND props IS NOT NULL AS DOUBLE)), 6) AS same, round(avg(CAST(json(props) = json('{}') AS DOUBLE)), 6) AS none FROM events GROUP BY event_type")
def exact_match_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves with other blanks, and against an empty one."""
    df = table(spark, sf_dir, "events").withColumn("blanks", F.regexp_replace("props", ":", " : ")).withColumn("none", F.lit("{}"))
    m = make("ExactMatch", convert_to="json")
    rows = {"same": Row(F.col("props"), F.col("blanks"), F.lit(1.0)), "none": Row(F.col("props"), F.col("none"), F.lit(1.0))}
    sums = df.groupBy(F.col("event_type").alias("t")).agg(*(F.sum(state(r)).alias(f"{n}|{s}") for n, r in rows.items() for s, state in m.states.items()))
    return sums.select("t", *(F.round(m.value({s: F.col(f"`{n}|{s}`") for s in m.states}), 6).alias(n) for n in rows))


# --- confusion matrices at thresholds -----------------------------------------------------------------------------------


def cells(t: float = 0.5) -> str:
    return f"sum(CASE WHEN prediction > {t} THEN weight * label ELSE 0 END) AS tp, sum(CASE WHEN prediction > {t} THEN weight * (1 - label) ELSE 0 END) AS fp, sum(CASE WHEN prediction > {t} THEN 0 ELSE weight * label END) AS fn, sum(CASE WHEN prediction > {t} THEN 0 ELSE weight * (1 - label) END) AS tn"


PT = "(tp + fn > 0 AND tn + fp > 0)"
POINT_SQL = {
    "TruePositives": "tp", "TrueNegatives": "tn", "FalsePositives": "fp", "FalseNegatives": "fn", "BinaryAccuracy": over("tp + tn", "tp + tn + fp + fn"), "Precision": over("tp", "tp + fp"), "Recall": over("tp", "tp + fn"),
    "Specificity": over("tn", "tn + fp"), "FallOut": over("fp", "fp + tn"), "MissRate": over("fn", "fn + tp"), "NegativePredictiveValue": over("tn", "tn + fn"), "FalseDiscoveryRate": over("fp", "fp + tp"),
    "FalseOmissionRate": over("fn", "fn + tn"), "Prevalence": over("tp + fn", "tp + tn + fp + fn"),
    "PrevalenceThreshold": f"CASE WHEN {PT} AND tp / (tp + fn) + tn / (tn + fp) <> 1 THEN (sqrt(tp / (tp + fn) * (1 - tn / (tn + fp))) + tn / (tn + fp) - 1) / (tp / (tp + fn) + tn / (tn + fp) - 1) END",
    "ThreatScore": over("tp", "tp + fn + fp"), "BalancedAccuracy": f"CASE WHEN {PT} THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END", "F1Score": over("2 * tp", "2 * tp + fp + fn"),
    "MatthewsCorrelationCoefficient": "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END",
    "FowlkesMallowsIndex": "CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN sqrt(tp / (tp + fp) * (tp / (tp + fn))) END", "Informedness": f"CASE WHEN {PT} THEN tp / (tp + fn) + tn / (tn + fp) - 1 END",
    "Markedness": "CASE WHEN tp + fp > 0 AND tn + fn > 0 THEN tp / (tp + fp) + tn / (tn + fn) - 1 END", "PositiveLikelihoodRatio": "CASE WHEN tp + fn > 0 AND fp > 0 THEN (tp / (tp + fn)) / (fp / (fp + tn)) END",
    "NegativeLikelihoodRatio": "CASE WHEN tp + fn > 0 AND tn > 0 THEN (fn / (tp + fn)) / (tn / (tn + fp)) END", "DiagnosticOddsRatio": "CASE WHEN fn > 0 AND tn > 0 AND fp > 0 THEN (tp / fn) / (fp / tn) END",
    "PredictedPositiveRate": over("tp + fp", "tp + tn + fp + fn"),
}

QUERIES["binary_point_metrics"] = per_slice([MetricConfig(n) for n in POINTS])
ORACLE_SQL["binary_point_metrics"] = ratios(cells(), POINT_SQL)

AT = ("Precision", "Recall", "F1Score", "TruePositives", "FalseNegatives")
QUERIES["points_at_other_thresholds"] = per_slice([MetricConfig(n, {"threshold": t}) for n in AT for t in (0.2, 0.85)] + [MetricConfig("MaxRecall")])
ORACLE_SQL["points_at_other_thresholds"] = (
    f"WITH {SLICED}, a AS (SELECT slice, {cells(0.2)} FROM sl GROUP BY slice), b AS (SELECT slice, {cells(0.85)} FROM sl GROUP BY slice), c AS (SELECT slice, {cells(1e-12)} FROM sl GROUP BY slice) SELECT a.slice, "
    + ", ".join(f'round((SELECT {POINT_SQL[n]} FROM {x} z WHERE z.slice = a.slice), 6) AS "{n}@{t:g}"' for n in AT for x, t in (("a", 0.2), ("b", 0.85)))
    + f', round((SELECT {POINT_SQL["Recall"]} FROM c z WHERE z.slice = a.slice), 6) AS "MaxRecall" FROM a'
)

EXACT = [0.0, 0.25, 0.5, 0.75, 1.0]


@query("exact_matrices", " UNION ALL ".join([f"(WITH {SLICED} SELECT slice, CAST({t} AS DOUBLE) AS threshold, round(tp, 4) AS tp, round(fp, 4) AS fp, round(fn, 4) AS fn, round(tn, 4) AS tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM (SELECT slice, {cells(t)} FROM sl GROUP BY slice))" for t in EXACT]))
def exact_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curves.with_rates(curves.exact_matrices(examples(spark, sf_dir), EXACT, SPECS))
    rates = shown(found, ["precision", "recall"], 6, ("threshold", *(F.round(c, 4).alias(c) for c in ("tp", "fp", "fn", "tn"))))
    return rates


# --- curves -------------------------------------------------------------------------------------------------------------

#: Buckets and the cells above each threshold, as SQL over tables ``b`` and ``th``.
HIST = f"""{SLICED}, b AS (
  SELECT slice, CAST(CASE WHEN prediction >= 1 THEN 10001 WHEN prediction < 0 THEN 0 ELSE floor(prediction * 10000) + 1 END AS BIGINT) AS bucket, sum(weight) AS w, sum(weight * label) AS wl, sum(weight * prediction) AS wp
  FROM sl GROUP BY 1, 2)"""
CELLS = """, m AS (
  SELECT slice, t, sum(CASE WHEN up THEN wl ELSE 0 END) AS tp, sum(CASE WHEN up THEN w - wl ELSE 0 END) AS fp, sum(CASE WHEN up THEN 0 ELSE wl END) AS fn, sum(CASE WHEN up THEN 0 ELSE w - wl END) AS tn
  FROM (SELECT *, bucket > 0 AND (bucket - 1) / CAST(10000 AS DOUBLE) + 1e-12 >= t AS up FROM b, th) GROUP BY 1, 2)"""
TH200 = ", th AS (SELECT CASE WHEN i = 0 THEN -1e-7 WHEN i = 199 THEN 1 + 1e-7 ELSE i / CAST(199 AS DOUBLE) END AS t FROM range(200) r(i))"


def sliced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.matrices(curves.histogram(examples(spark, sf_dir), SPECS), curves.interpolated_thresholds(200))


STEPS = ", p AS (SELECT *, lead(tp) OVER o AS tp2, lead(fp) OVER o AS fp2, lead(fn) OVER o AS fn2, lead(tn) OVER o AS tn2 FROM m WINDOW o AS (PARTITION BY slice ORDER BY t))"
X, X2, Y, Y2 = "fp / nullif(fp + tn, 0)", "fp2 / nullif(fp2 + tn2, 0)", "tp / nullif(tp + fn, 0)", "tp2 / nullif(tp2 + fn2, 0)"
P, P2 = "tp / nullif(tp + fp, 0)", "tp2 / nullif(tp2 + fp2, 0)"
ENDS = {"minoring": lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END", "majoring": lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END", "interpolation": lambda a, b: f"({a} + {b}) / 2"}
SLOPE = "coalesce((tp - tp2) / nullif((tp + fp) - (tp2 + fp2), 0), 0)"
PR_AREA = f"{SLOPE} * ((tp - tp2) + (tp2 - {SLOPE} * (tp2 + fp2)) * CASE WHEN tp + fp > 0 AND tp2 + fp2 > 0 THEN ln((tp + fp) / (tp2 + fp2)) ELSE 0 END) / nullif(tp2 + fn2, 0)"
AREAS = {f"roc_{k}": f"({X} - {X2}) * {e(Y, Y2)}" for k, e in ENDS.items()} | {f"pr_{k}": PR_AREA if k == "interpolation" else f"({Y} - {Y2}) * {e(P, P2)}" for k, e in ENDS.items()}


@query("auc", f"WITH {HIST}{TH200}{CELLS}{STEPS} SELECT slice, " + ", ".join(f"round(coalesce(sum(CASE WHEN tp2 IS NOT NULL THEN {a} END), 0), 6) AS {n}" for n, a in AREAS.items()) + " FROM p GROUP BY slice")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {name: (name.split("_")[0].upper(), name.split("_")[1]) for name in AREAS}
    return shown(curves.summary(sliced_cells(spark, sf_dir), wanted), list(AREAS))


BOUNDS = {"SensitivityAtSpecificity": 0.4, "SpecificityAtSensitivity": 0.4, "PrecisionAtRecall": 0.3, "RecallAtPrecision": 0.2, "RecallAtFalsePositiveRate": 0.35, "ThresholdAtRecall": 0.6}
RATE_SQL = {"tpr": over("tp", "tp + fn"), "tnr": over("tn", "tn + fp"), "fpr": over("fp", "fp + tn"), "precision": over("tp", "tp + fp"), "threshold": "t"}


@query("metrics_under_constraints", f"WITH {HIST}{TH200}{CELLS} SELECT slice, " + ", ".join(f"round(coalesce(max(CASE WHEN ({RATE_SQL[c]}) {'>=' if ge else '<='} {BOUNDS[n]} THEN {RATE_SQL[d]} END), 0), 6) AS \"{n}\"" for n, (d, c, ge) in curves.CONSTRAINED.items()) + " FROM m GROUP BY slice")
def metrics_under_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(curves.summary(sliced_cells(spark, sf_dir), bounds={n: (n, b) for n, b in BOUNDS.items()}), list(BOUNDS))


TH100 = ", th AS (SELECT -1e-6 AS t UNION ALL SELECT i / CAST(100 AS DOUBLE) FROM range(101) r(i))"


@query("confusion_plot", f"WITH {HIST}{TH100}{CELLS} SELECT slice, round(t, 8) AS threshold, round(tp, 4) AS tp, round(fp, 4) AS fp, round(fn, 4) AS fn, round(tn, 4) AS tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM m")
def confusion_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curves.confusion_plot(curves.histogram(examples(spark, sf_dir), SPECS), 100)
    return shown(found, ["precision", "recall"], 6, (F.round("threshold", 8).alias("threshold"), *(F.round(c, 4).alias(c) for c in ("tp", "fp", "fn", "tn"))))


@query("score_distribution", f"WITH {HIST}{TH100}{CELLS} SELECT slice, round(t, 8) AS threshold, round(tp + fp, 4) AS above, round(tn + fn, 4) AS below FROM m")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(curves.score_distribution(curves.histogram(examples(spark, sf_dir), SPECS), 100), ["above", "below"], 4, (F.round("threshold", 8).alias("threshold"),))


@query("calibration_plot", f"WITH {HIST} SELECT slice, round(CAST(floor((bucket - 1) / 1000) AS DOUBLE) / 10, 6) AS lower, round(sum(w), 4) AS w, round(sum(wl), 4) AS wl, round(sum(wp), 4) AS wp FROM b WHERE bucket BETWEEN 1 AND 10000 GROUP BY 1, 2")
def calibration_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curves.calibration_plot(curves.histogram(examples(spark, sf_dir), SPECS), points=10).where("lower >= 0 and lower < 1")
    return shown(found, ["w", "wl", "wp"], 4, (F.round("lower", 6).alias("lower"),))


@query("false_positive_features", f"WITH {BASE}, d AS (SELECT DISTINCT l_linestatus AS s, l_partkey AS v FROM base WHERE prediction > 0.9 AND label <= 0.9), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY v) AS n FROM d) SELECT 'l_linestatus:' || s AS slice, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS features FROM r WHERE n <= 10 GROUP BY s")
def false_positive_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten parts of false positives for each slice, the least first."""
    found = curves.feature_sample(examples(spark, sf_dir), "l_partkey", "fp", 0.9, 10, SPECS[1:2], order=F.col("l_partkey"))
    return found.select(slicing.slice_name(F.col("slice_key")).alias("slice"), F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("features"))


# --- slices -------------------------------------------------------------------------------------------------------------


@query("slices_by_value", f"WITH {BASE} SELECT 'l_linenumber_X_l_returnflag:' || l_linenumber || '_X_R' AS slice, CAST(sum(weight) AS DOUBLE) AS \"ExampleCount\" FROM base WHERE l_returnflag = 'R' GROUP BY l_linenumber UNION ALL SELECT 'l_linenumber:3', sum(weight) FROM base WHERE l_linenumber = 3")
def slices_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = (SlicingSpec(("l_linenumber",), {"l_returnflag": "R"}), SlicingSpec((), {"l_linenumber": 3}))
    return per_slice([MetricConfig("ExampleCount")], specs=specs)(spark, sf_dir)


TAGS = "d AS (SELECT *, list_distinct([lang, source, lang]) AS tags FROM documents)"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source", "lang")).withColumn("size", F.col("n_chars").cast("double"))


@query("slices_of_many_values", f"WITH {TAGS}, e AS (SELECT n_chars, lang, unnest(tags) AS tag FROM d) SELECT 'tags:' || tag AS slice, CAST(count(*) AS DOUBLE) AS \"ExampleCount\", round(avg(n_chars), 6) AS \"Mean(size)\" FROM e GROUP BY tag UNION ALL SELECT 'lang_X_tags:' || lang || '_X_' || tag, count(*), round(avg(n_chars), 6) FROM e GROUP BY lang, tag")
def slices_of_many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = EvalConfig((ModelSpec("0D", "0D"),), (SlicingSpec(("tags",)), SlicingSpec(("tags", "lang"))), (MetricConfig("ExampleCount"), MetricConfig("Mean", {"column": "size"})))
    return shown(wide(tagged(spark, sf_dir), config), ["ExampleCount", "Mean(size)"])


@query("slices_by_sql", f"WITH {TAGS}, e AS (SELECT *, unnest(tags) AS tag FROM d WHERE n_chars > 1000) SELECT 'tag:' || tag AS slice, CAST(count(*) AS DOUBLE) AS \"ExampleCount\" FROM e WHERE tag <> 'en' GROUP BY tag UNION ALL SELECT 'big_X_lang:' || CAST(n_chars > 5000 AS VARCHAR) || '_X_' || lang, count(*) FROM d WHERE list_contains(tags, 'src1') GROUP BY 1")
def slices_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = (
        SlicingSpec(sql="SELECT STRUCT(tags AS tag) FROM example.tags WHERE example.n_chars > 1000 AND tags != 'en'"),
        SlicingSpec(sql="SELECT STRUCT(example.lang, example.n_chars > 5000 AS big) WHERE 'src1' IN UNNEST(example.tags)"),
    )
    return shown(wide(tagged(spark, sf_dir), EvalConfig((ModelSpec("0D", "0D"),), specs, (MetricConfig("ExampleCount"),))), ["ExampleCount"])


@query("cross_slices", f"WITH {SLICED}, s AS (SELECT slice, sum(weight * label) / sum(weight) AS v FROM sl GROUP BY slice) SELECT a.slice AS baseline, b.slice AS comparison, round(a.v - b.v, 6) AS value FROM s a, s b WHERE a.slice = 'Overall' AND b.slice LIKE 'l_linestatus:%'")
def cross_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate(examples(spark, sf_dir), EvalConfig((ModelSpec(MODELS["label"], "score", "l_quantity"),), SPECS, (MetricConfig("MeanLabel"),)))["metrics"]
    crossed = slicing.cross_slices(found, OVERALL, SPECS[1:2])
    name = lambda c: slicing.slice_name(F.col(c))
    return crossed.select(name("baseline_key").alias("baseline"), name("comparison_key").alias("comparison"), F.round("value", 6).alias("value"))


@query("small_slices_hidden", "SELECT 'o_orderpriority_X_o_orderstatus:' || o_orderpriority || '_X_' || o_orderstatus AS slice, CASE WHEN count(*) >= 1000 THEN round(avg(o_totalprice), 4) END AS value, count(*) < 1000 AS hidden FROM orders GROUP BY o_orderpriority, o_orderstatus UNION ALL SELECT 'Overall', round(avg(o_totalprice), 4), false FROM orders")
def small_slices_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = EvalConfig((ModelSpec("0D", "0D"),), (OVERALL, SlicingSpec(("o_orderstatus", "o_orderpriority"))), (MetricConfig("Mean", {"column": "o_totalprice"}),), options=Options(min_slice_size=1000))
    found = evaluate(table(spark, sf_dir, "orders"), config)["metrics"]
    return found.select("slice", F.round("value", 4).alias("value"), F.col("error").isNotNull().alias("hidden"))


# --- two models ---------------------------------------------------------------------------------------------------------

TWO = (ModelSpec(MODELS["label"], "other", "l_quantity", "base", True), ModelSpec(MODELS["label"], "score", "l_quantity", "new"))
FLIP_SQL = {"NegToNegFlipRate": ("<=", "<="), "NegToPosFlipRate": ("<=", ">"), "PosToNegFlipRate": (">", "<="), "PosToPosFlipRate": (">", ">")}
PAIR_SUMS = "sum(weight) AS w, " + ", ".join(f"sum(CASE WHEN other {a} 0.5 AND prediction {b} 0.5 THEN weight ELSE 0 END) AS {n}" for n, (a, b) in FLIP_SQL.items()) + ", sum(CASE WHEN abs(other) < 1e-7 AND abs(prediction) < 1e-7 THEN 0 ELSE weight * 2 * abs(other - prediction) / abs(other + prediction) END) AS gap"


@query("model_flips", ratios(PAIR_SUMS, {n: f"{n} / w" for n in FLIP_SQL} | {"SymmetricFlipRate": "(NegToPosFlipRate + PosToNegFlipRate) / w", "SymmetricPredictionDifference": "gap / w"}))
def model_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*FLIP_SQL, "SymmetricFlipRate", "SymmetricPredictionDifference"]
    found = wide(examples(spark, sf_dir), EvalConfig(TWO, SPECS, tuple(map(MetricConfig, names))))
    return shown(found.select("slice_key", *(F.col(f"`new/{n}`").alias(n) for n in names)), names)


@query("model_differences", f"WITH {SLICED}, s AS (SELECT slice, sum(weight * prediction) / sum(weight) AS n, sum(weight * other) / sum(weight) AS o FROM sl GROUP BY slice) SELECT slice, 'new' AS model, round(n, 6) AS value, round(n - o, 6) AS change FROM s UNION ALL SELECT slice, 'base', round(o, 6), NULL FROM s")
def model_differences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate(examples(spark, sf_dir), EvalConfig(TWO, SPECS, (MetricConfig("MeanPrediction"),)))["metrics"]
    return found.select("slice", "model", F.round("value", 6).alias("value"), F.round("change", 6).alias("change"))


@query("model_cosine", "SELECT 'label:' || label AS slice, round(avg(list_cosine_similarity(CAST(embedding[1:32] AS DOUBLE[]), CAST(embedding[33:64] AS DOUBLE[]))), 6) AS \"ModelCosineSimilarity\" FROM embeddings GROUP BY label")
def model_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = (ModelSpec("label", "slice(embedding, 1, 32)", None, "a", True), ModelSpec("label", "slice(embedding, 33, 32)", None, "b"))
    found = wide(table(spark, sf_dir, "embeddings"), EvalConfig(models, (SlicingSpec(("label",)),), (MetricConfig("ModelCosineSimilarity"),)))
    return shown(found.withColumnRenamed("b/ModelCosineSimilarity", "ModelCosineSimilarity"), ["ModelCosineSimilarity"])


@query("counterfactual", f"WITH {SLICED}, s AS (SELECT slice, avg(l_discount * 10) AS a, avg(l_tax * 10) AS b FROM sl GROUP BY slice) SELECT slice, round(a, 6) AS \"plain/MeanPrediction\", round(b, 6) AS \"changed/MeanPrediction\" FROM s")
def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's prediction as it is, and with one of its inputs replaced by another column."""
    from metricloom.plans.tables import counterfactual as changed

    df = changed(examples(spark, sf_dir), lambda x: x["l_discount"] * 10, ["l_discount"], {"plain": {}, "changed": {"l_discount": F.col("l_tax")}})
    models = tuple(ModelSpec(MODELS["label"], n, None, n) for n in ("plain", "changed"))
    return shown(wide(df, EvalConfig(models, SPECS, (MetricConfig("MeanPrediction"),))), ["plain/MeanPrediction", "changed/MeanPrediction"])


# --- classes ------------------------------------------------------------------------------------------------------------

SCORES = "e AS (SELECT vec_id, label, CAST(embedding[1:10] AS DOUBLE[]) AS p FROM embeddings)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whose first ten numbers stand for scores of the ten classes."""
    df = table(spark, sf_dir, "embeddings").withColumn("prediction", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))).withColumn("weight", F.lit(1.0))
    return df.withColumn("hot", inputs.one_hot(F.col("label"), F.size("prediction")))


@query("multiclass_confusion", f"WITH {SCORES}, t AS (SELECT unnest([0.1, 0.2]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(label AS INTEGER) AS actual, CAST(CASE WHEN list_max(p) > threshold THEN list_position(p, list_max(p)) - 1 ELSE -1 END AS INTEGER) AS predicted, CAST(count(*) AS DOUBLE) AS w FROM e, t GROUP BY 1, 2, 3")
def multiclass_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiclass.confusion(scored(spark, sf_dir), (0.1, 0.2)).select("threshold", "actual", "predicted", "w")


@query("multilabel_confusion", f"WITH {SCORES}, c AS (SELECT label, p, unnest(range(0, 10)) AS c FROM e) SELECT CAST(label AS INTEGER) AS actual, CAST(c AS INTEGER) AS predicted, CAST(sum(CAST(c = label AND p[c + 1] > 0.1 AS INTEGER)) AS DOUBLE) AS tp, CAST(sum(CAST(c <> label AND p[c + 1] > 0.1 AS INTEGER)) AS DOUBLE) AS fp, CAST(sum(CAST(c = label AND p[c + 1] <= 0.1 AS INTEGER)) AS DOUBLE) AS fn, CAST(sum(CAST(c <> label AND p[c + 1] <= 0.1 AS INTEGER)) AS DOUBLE) AS tn FROM c GROUP BY 1, 2")
def multilabel_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiclass.multi_label(scored(spark, sf_dir), (0.1,), label="hot").select("actual", "predicted", "tp", "fp", "fn", "tn")


CLASS_CELLS = f"{SCORES}, x AS (SELECT label, p, unnest(range(0, 10)) AS c FROM e), k AS (SELECT c, CAST(sum(CAST(c = label AND p[c + 1] > 0.1 AS INTEGER)) AS DOUBLE) AS tp, CAST(sum(CAST(c <> label AND p[c + 1] > 0.1 AS INTEGER)) AS DOUBLE) AS fp, CAST(sum(CAST(c = label AND p[c + 1] <= 0.1 AS INTEGER)) AS DOUBLE) AS fn FROM x GROUP BY c)"


@query("class_averages", f"WITH {CLASS_CELLS}, v AS (SELECT c, tp / nullif(tp + fp, 0) AS v, tp + fn AS n, tp, fp FROM k) SELECT round(avg(v), 6) AS macro, round(sum(v * n) / sum(n), 6) AS weighted_macro, round(sum(tp) / sum(tp + fp), 6) AS micro, round((max(CASE WHEN c = 1 THEN v END) * 2 + max(CASE WHEN c = 3 THEN v END)) / 3, 6) AS own_weights FROM v")
def class_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiclass.class_cells(scored(spark, sf_dir), 0.1, label="hot")
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    out = None
    for name, how, weights in (("macro", "macro", None), ("weighted_macro", "weighted_macro", None), ("micro", "micro", None), ("own_weights", "macro", {1: 2.0, 3: 1.0})):
        one = multiclass.average(found, precision, how, weights, name)
        out = one if out is None else out.join(one, "slice_key")
    return out.select(*(F.round(c, 6).alias(c) for c in ("macro", "weighted_macro", "micro", "own_weights")))


@query("top_k_classes", f"WITH {SCORES}, r AS (SELECT vec_id, label, c, row_number() OVER (PARTITION BY vec_id ORDER BY p[c + 1] DESC, c) AS n FROM (SELECT *, unnest(range(0, 10)) AS c FROM e)) SELECT CAST(label AS INTEGER) AS label, CAST(count(DISTINCT CASE WHEN n <= 3 AND c = label THEN vec_id END) AS BIGINT) AS in_top_3, CAST(count(CASE WHEN n = 2 AND c = label THEN 1 END) AS BIGINT) AS second FROM r GROUP BY label")
def top_k_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the class is among the best three, and just the second."""
    df = scored(spark, sf_dir)
    _, labels = inputs.top_k(F.col("prediction"), F.col("hot"), 3)
    _, second = inputs.kth(F.col("prediction"), F.col("hot"), 2)
    return df.groupBy(F.col("label").cast("int").alias("label")).agg(F.sum(F.exists(labels, lambda x: x == 1).cast("long")).alias("in_top_3"), F.sum((second == 1).cast("long")).alias("second"))


@query("categorical_metrics", f"WITH {SCORES}, q AS (SELECT label, p, list_sum(list_transform(p, lambda x: exp(x))) AS z FROM e) SELECT round(avg(CAST(list_position(p, list_max(p)) - 1 = label AS DOUBLE)), 6) AS accuracy, round(avg(ln(z) - p[label + 1]), 6) AS crossentropy FROM q")
def categorical_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    a = wide(df, EvalConfig((ModelSpec("hot", "prediction"),), (OVERALL,), (MetricConfig("CategoricalAccuracy"), MetricConfig("CategoricalCrossEntropy", {"from_logits": True}))))
    return a.select(F.round("CategoricalAccuracy", 6).alias("accuracy"), F.round("CategoricalCrossEntropy", 6).alias("crossentropy"))


BINARY_SQL = f"""WITH {SCORES}, x AS (SELECT vec_id, label, p, unnest(range(0, 10)) AS c FROM e), r AS (SELECT *, CAST(c = label AS INTEGER) AS l, p[c + 1] AS v, row_number() OVER (PARTITION BY vec_id ORDER BY p[c + 1] DESC, c) AS n FROM x),
u AS (SELECT 'class:' || c AS sub_key, l, v > 0.1 AS up FROM r WHERE c IN (1, 4) UNION ALL SELECT 'k:2', l, v > 0.1 FROM r WHERE n = 2 UNION ALL SELECT 'top_k:3', l, n <= 3 AND v > 0.1 FROM r)
SELECT sub_key, round(sum(CASE WHEN up THEN l ELSE 0 END) / nullif(CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) AS DOUBLE), 0), 6) AS "Precision@0.1", round(sum(CASE WHEN up THEN l ELSE 0 END) / nullif(CAST(sum(l) AS DOUBLE), 0), 6) AS "Recall@0.1" FROM u GROUP BY sub_key"""


@query("binarized_classes", BINARY_SQL)
def binarized_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classes against the rest, the second best class, and the best three."""
    rows = binarized(scored(spark, sf_dir).withColumn("label", F.col("hot")), (1, 4), (2,), (3,))
    config = EvalConfig(metrics=(MetricConfig("Precision", {"threshold": 0.1}), MetricConfig("Recall", {"threshold": 0.1})))
    found = wide(rows, config, ["sub_key"])
    return found.select("sub_key", *(F.round(null_if_nan(F.col(f"`{n}`")), 6).alias(n) for n in ("Precision@0.1", "Recall@0.1")))


@query("vocabulary_labels", "SELECT CAST(coalesce(list_position(['A', 'N'], l_returnflag), 0) - 1 AS INTEGER) AS class, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def vocabulary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).groupBy(inputs.class_index(F.col("l_returnflag"), ["A", "N"]).alias("class")).agg(F.count("*").alias("n"))


ORDER_SETS = f"{BASE}, o AS (SELECT l_orderkey AS k, l_suppkey % 5 AS i, max(label) AS l, max(prediction) AS p, max(CAST(l_linestatus = 'O' AS INTEGER)) AS s FROM base GROUP BY 1, 2)"


@query("set_match", f"WITH {ORDER_SETS} SELECT round(sum(CASE WHEN l = 1 AND s = 1 AND p > 0.3 THEN 1.0 ELSE 0 END) / sum(CASE WHEN s = 1 AND p > 0.3 THEN 1.0 ELSE 0 END), 6) AS precision, round(sum(CASE WHEN l = 1 AND s = 1 AND p > 0.3 THEN 1.0 ELSE 0 END) / sum(CASE WHEN l = 1 THEN 1.0 ELSE 0 END), 6) AS recall FROM o")
def set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order has a set of true and a set of predicted items."""
    items = examples(spark, sf_dir).groupBy("l_orderkey", (F.col("l_suppkey") % 5).alias("item")).agg(F.max("label").alias("l"), F.max("prediction").alias("p"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("s"))
    orders = items.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l") == 1, F.col("item"))).alias("labels"), F.collect_list(F.when(F.col("s") == 1, F.struct("item", "p"))).alias("z"))
    rows = multiclass.set_matches(orders.select("labels", F.col("z.item").alias("classes"), F.col("z.p").alias("scores"), F.lit(1.0).alias("weight")))
    found = curves.exact_matrices(rows, [0.3])
    return found.select(F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


@query("segmentation", "WITH p AS (SELECT CAST(l_quantity AS BIGINT) % 3 AS t, l_partkey % 3 AS p FROM lineitem), c AS (SELECT unnest([0, 1, 2]) AS c) SELECT CAST(c AS INTEGER) AS class_id, CAST(sum(CAST(t = c AND p = c AS INTEGER)) AS DOUBLE) AS tp, CAST(sum(CAST(t <> c AND p = c AND t <> 0 AS INTEGER)) AS DOUBLE) AS fp, CAST(sum(CAST(t = c AND p <> c AS INTEGER)) AS DOUBLE) AS fn, CAST(sum(CAST(t <> c AND p <> c AND t <> 0 AS INTEGER)) AS DOUBLE) AS tn FROM p, c GROUP BY c")
def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images, their lines as pixels."""
    images = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_quantity").cast("long") % 3).alias("t"), (F.col("l_partkey") % 3).alias("p"))).alias("z"))
    return multiclass.segmentation(images.select(F.col("z.t").alias("truth"), F.col("z.p").alias("predicted")), [0, 1, 2], ignore=0).drop("slice_key")


ATTRIBUTION_SQL = "SELECT slice, 'discount' AS feature, sum(weight * (l_discount - 0.05)) AS t, sum(abs(weight * (l_discount - 0.05))) AS a, sum(weight) AS w FROM sl GROUP BY slice UNION ALL SELECT slice, 'tax', sum(weight * (0.04 - l_tax)), sum(abs(weight * (0.04 - l_tax))), sum(weight) FROM sl GROUP BY slice"


@query("attributions", f"WITH {SLICED}, t AS ({ATTRIBUTION_SQL}) SELECT slice, feature, round(t, 4) AS total, round(a, 4) AS total_absolute, round(t / w, 6) AS mean, round(a / w, 6) AS mean_absolute FROM t")
def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = examples(spark, sf_dir).withColumn("a", F.create_map(F.lit("discount"), F.col("l_discount") - 0.05, F.lit("tax"), 0.04 - F.col("l_tax")))
    out = None
    for name, absolute, mean in (("total", False, False), ("total_absolute", True, False), ("mean", False, True), ("mean_absolute", True, True)):
        one = multiclass.attributions(df, "a", absolute, mean, specs=SPECS, weight="weight").withColumnRenamed("value", name)
        out = one if out is None else out.join(one, ["slice_key", "feature"])
    name = slicing.slice_name(F.col("slice_key")).alias("slice")
    return out.select(name, "feature", *(F.round(c, 6 if "mean" in c else 4).alias(c) for c in ("total", "total_absolute", "mean", "mean_absolute")))


DRAW = "(CAST((l_orderkey * 15485863 + l_partkey * 7919 + l_suppkey * 31 + l_linenumber * 104729) % 1000003 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000003 AS DOUBLE)"


@query("fixed_size_sample", f"WITH {SLICED}, o AS (SELECT slice, l_partkey, power({DRAW}, 1 / weight) AS o FROM sl WHERE slice NOT LIKE '%_X_%'), r AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY o DESC, l_partkey) AS n FROM o) SELECT slice, CAST(row_number() OVER (PARTITION BY slice ORDER BY l_partkey) - 1 AS INTEGER) AS i, l_partkey FROM r WHERE n <= 20")
def fixed_size_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiclass.fixed_sample(examples(spark, sf_dir), "l_partkey", 20, SPECS[:2], "weight", uniform=F.expr(DRAW))
    return found.select(slicing.slice_name(F.col("slice_key")).alias("slice"), F.posexplode("values").alias("i", "l_partkey"))


# --- queries and rankings -----------------------------------------------------------------------------------------------

RANKED = f"{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY prediction DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS m FROM base)"
ORDERED = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("ndcg", f"WITH {RANKED}, q AS (SELECT l_orderkey, " + ", ".join(f"sum(CASE WHEN n <= {k} THEN l_quantity / log2(n + 1) ELSE 0 END) / sum(CASE WHEN m <= {k} THEN l_quantity / log2(m + 1) ELSE 0 END) AS v{k}" for k in (1, 3, 5)) + " FROM r GROUP BY l_orderkey) " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, round(avg(v{k}), 6) AS value FROM q" for k in (1, 3, 5)))
def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.ndcg(examples(spark, sf_dir), "l_orderkey", "l_quantity", (1, 3, 5), order=ORDERED)
    return found.select("k", F.round("value", 6).alias("value"))


@query("min_label_position", f"WITH {RANKED}, q AS (SELECT l_orderkey, min(CASE WHEN label > 0 THEN n END) AS f FROM r GROUP BY l_orderkey) SELECT round(avg(f), 6) AS value FROM q WHERE f IS NOT NULL")
def min_label_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.min_label_position(examples(spark, sf_dir), "l_orderkey", order=ORDERED).select(F.round("value", 6).alias("value"))


@query("query_statistics", "WITH q AS (SELECT conv_id, count(*) AS n, list_distinct(list(role)) AS roles FROM conversations GROUP BY conv_id), e AS (SELECT conv_id, n, unnest(roles) AS r FROM q) SELECT 'role:' || r AS slice, CAST(count(*) AS DOUBLE) AS total_queries, CAST(sum(n) AS DOUBLE) AS total_documents, CAST(min(n) AS DOUBLE) AS min_documents, CAST(max(n) AS DOUBLE) AS max_documents FROM e GROUP BY r UNION ALL SELECT 'Overall', count(*), sum(n), min(n), max(n) FROM q")
def query_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.query_statistics(table(spark, sf_dir, "conversations"), "conv_id", specs=(OVERALL, SlicingSpec(("role",))))
    return shown(found, ["total_queries", "total_documents", "min_documents", "max_documents"])


# --- intervals and validation -------------------------------------------------------------------------------------------

RATES = {"MeanLabel": "wl / w", "Calibration": "wp / wl"}
JK = "(l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 20"
T19 = 2.093024054408263
BOUND_SQL = "round(m, 8) AS sample_mean, round(se, 8) AS standard_error, round(m - {t} * se, 6) AS lower, round(m + {t} * se, 6) AS upper"


def rate_states() -> dict[str, Column]:
    w, l, p = F.col("weight"), F.col("label"), F.col("prediction")
    return {"w": w, "wl": w * l, "wp": w * p}


def rate_values() -> dict:
    return {n: make(n).value for n in RATES}


def intervals(found: DataFrame) -> DataFrame:
    digits = {"value": 6, "sample_mean": 8, "standard_error": 8, "lower": 6, "upper": 6}
    return found.select(slicing.slice_name(F.col("slice_key")).alias("slice"), "metric", *(F.round(null_if_nan(F.col(c)), d).alias(c) for c, d in digits.items()))


JK_SQL = f"""WITH {SLICED}, s AS (SELECT slice, {JK} AS b, sum(weight) AS w, sum(weight * label) AS wl, sum(weight * prediction) AS wp FROM sl GROUP BY 1, 2),
t AS (SELECT slice, sum(w) AS w, sum(wl) AS wl, sum(wp) AS wp FROM s GROUP BY slice),
o AS (SELECT t.slice, t.w - coalesce(s.w, 0) AS w, t.wl - coalesce(s.wl, 0) AS wl, t.wp - coalesce(s.wp, 0) AS wp FROM t CROSS JOIN range(20) r(i) LEFT JOIN s ON s.slice = t.slice AND s.b = i)
""" + " UNION ALL ".join(f"(SELECT t.slice, '{n}' AS metric, round(CASE WHEN t.wl > 0 OR '{n}' = 'MeanLabel' THEN {v.replace('w', 't.w')} END, 6) AS value, {BOUND_SQL.format(t=T19)} FROM t JOIN (SELECT slice, CASE WHEN count(v) = 20 THEN avg(v) END AS m, CASE WHEN count(v) = 20 THEN stddev_samp(v) END * 19 / sqrt(20) AS se FROM (SELECT slice, CASE WHEN wl > 0 OR '{n}' = 'MeanLabel' THEN {v} END AS v FROM o) GROUP BY slice) z USING (slice))" for n, v in RATES.items())


@query("jackknife", JK_SQL)
def jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(confidence.jackknife(examples(spark, sf_dir), rate_states(), rate_values(), F.expr(JK), SPECS))


POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974149, 0.9999998885745217, 0.9999999899522336, 0.999999999168389]
BS_U = "CAST((l_orderkey * 7919 + l_partkey * 31 + l_linenumber * 104729 + {i} * 1299709) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE)"
BS_SQL = f"""WITH {SLICED}, d AS (SELECT *, (""" + " + ".join(f"CAST(u >= {b!r} AS INTEGER)" for b in POISSON) + f""") AS c FROM (SELECT *, {BS_U.format(i='i')} AS u FROM sl, range(20) r(i))),
o AS (SELECT slice, i, sum(c * weight) AS w, sum(c * weight * label) AS wl, sum(c * weight * prediction) AS wp FROM d GROUP BY 1, 2),
t AS (SELECT slice, sum(weight) AS w, sum(weight * label) AS wl, sum(weight * prediction) AS wp FROM sl GROUP BY slice)
""" + " UNION ALL ".join(f"(SELECT t.slice, '{n}' AS metric, round(CASE WHEN t.wl > 0 OR '{n}' = 'MeanLabel' THEN {v.replace('w', 't.w')} END, 6) AS value, {BOUND_SQL.format(t=T19)} FROM t JOIN (SELECT slice, CASE WHEN count(v) = 20 THEN avg(v) END AS m, CASE WHEN count(v) = 20 THEN stddev_samp(v) END AS se FROM (SELECT slice, CASE WHEN wl > 0 OR '{n}' = 'MeanLabel' THEN {v} END AS v FROM o) GROUP BY slice) z USING (slice))" for n, v in RATES.items())


@query("bootstrap", BS_SQL)
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(confidence.bootstrap(examples(spark, sf_dir), rate_states(), rate_values(), lambda i: F.expr(BS_U.format(i=i)), SPECS))


@query("threshold_validation", f"WITH {SLICED}, s AS (SELECT slice, sum(weight * label) / sum(weight) AS v, sum(weight * prediction) / sum(weight) - sum(weight * other) / sum(weight) AS c FROM sl GROUP BY slice) SELECT 'MeanLabel' AS metric, slice, CAST(0 AS INTEGER) AS threshold, v BETWEEN 0.2 AND 0.33 AS ok FROM s WHERE slice LIKE 'l_linestatus:%' UNION ALL SELECT 'MeanPrediction', slice, 1, c >= -0.001 FROM s WHERE slice = 'Overall' UNION ALL SELECT 'Recall', 'missing', 2, false")
def threshold_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate(examples(spark, sf_dir), EvalConfig(TWO, SPECS, (MetricConfig("MeanLabel"), MetricConfig("MeanPrediction"))))["metrics"]
    wanted = [validation.Threshold("MeanLabel", 0.2, 0.33, spec=SPECS[1], model="new"), validation.Threshold("MeanPrediction", direction="higher", absolute=-0.001, model="new"), validation.Threshold("Recall", 0.5, model="new")]
    out = validation.validate(found, wanted)
    return out.select("metric", F.when(F.col("slice_key").isNull(), "missing").otherwise(slicing.slice_name(F.col("slice_key"))).alias("slice"), "threshold", "ok")


# --- detection, texts, streams ------------------------------------------------------------------------------------------


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images: each line is a box, and a detection that is moved by its discount and tax."""
    x, y = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    size, kind = F.col("l_quantity") + 10, (F.col("l_linenumber") % 2).cast("double")
    off = F.col("l_discount") * 40
    box = F.array(x, y, x + size, y + size, kind).alias("t")
    found = F.array(x + off, y + F.col("l_tax") * 40, x + off + size, y + size, kind, F.col("prediction")).alias("f")
    pairs = examples(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", box, found))).alias("z"))
    return pairs.select("l_orderkey", F.col("z.t").alias("truth"), F.filter(F.col("z.f"), lambda f: f[5] > 0.2).alias("found"))


@query("object_detection")
def object_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and recall for each class at the ten overlaps."""
    rows = detection.matched(images(spark, sf_dir), iou=detection.IOUS, classes=(0, 1), most=100)
    return detection.average_precision(rows).select("class_id", F.round("iou", 2).alias("iou"), F.round("value", 6).alias("average_precision"), F.round("recall", 6).alias("average_recall"))


@query("detection_at_threshold")
def detection_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detection.matched(images(spark, sf_dir), iou=(0.5,), classes=(None,), area=(400.0, 2500.0))
    found = curves.exact_matrices(rows, [0.3, 0.6])
    return found.select("threshold", *(F.round(F.try_divide("tp", F.col("tp") + F.col(c)), 6).alias(n) for c, n in (("fp", "precision"), ("fn", "recall"))))


@query("detection_under_constraints")
def detection_under_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and the threshold at a recall, and the greatest recall, over matched boxes."""
    rows = detection.matched(images(spark, sf_dir))
    cells, out = curves.matrices(curves.histogram(rows), [1e-12, *(i / 100 for i in range(1, 101))]), None
    for name, bound in (("PrecisionAtRecall", 0.4), ("ThresholdAtRecall", 0.4), ("RecallAtPrecision", 0.5)):
        one = curves.constrained(cells, name, bound).select(F.lit(name).alias("metric"), F.round("value", 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    most = curves.exact_matrices(rows, [1e-12]).select(F.lit("MaxRecall").alias("metric"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("value"))
    return out.unionByName(most)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of the assistant against the turns of the user before and after."""
    turns = table(spark, sf_dir, "conversations")
    own, other = turns.where("role = 'assistant'"), turns.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("u"))
    near = own.join(other, "conv_id").where("abs(turn - t) = 1").groupBy("conv_id", "turn").agg(F.first("text").alias("hypothesis"), F.array_sort(F.collect_list("u")).alias("references"))
    return near


@query("bleu")
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = textscores.bleu(answers(spark, sf_dir), specs=(OVERALL, SlicingSpec(("turn",))))
    return shown(found, ["value", "brevity", "hypothesis_length", "reference_length"])


@query("rouge")
def rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = answers(spark, sf_dir), None
    for kind in ("rouge1", "rouge2", "rougeL", "rougeLsum"):
        one = shown(textscores.rouge(df, kind), ["precision", "recall", "fmeasure"]).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("windowed_metrics", "SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS start, 'event_type:' || event_type AS slice, CAST(count(*) AS DOUBLE) AS \"ExampleCount\", round(avg(value), 6) AS \"MeanPrediction\" FROM events GROUP BY 1, 2")
def windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the stream over the whole table: a day at a time."""
    df = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    config = EvalConfig((ModelSpec("0D", "value"),), (SlicingSpec(("event_type",)),), (MetricConfig("ExampleCount"), MetricConfig("MeanPrediction")))
    found = running_metrics(df, config, "ts", "1 day")
    return shown(found, ["ExampleCount", "MeanPrediction"], keep=(F.col("window.start").cast("timestamp_ntz").alias("start"),)).select("start", "slice", "ExampleCount", "MeanPrediction")


@query("analysis_table", f"WITH {BASE} SELECT l_orderkey, l_linenumber, l_partkey, label, round(prediction, 8) AS prediction, weight, 'Overall;l_linestatus:' || l_linestatus || ';l_linestatus_X_l_returnflag:' || l_linestatus || '_X_' || l_returnflag AS slices FROM base")
def analysis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as metrics see them, with the slices that each belongs to."""
    from metricloom.plans.tables import analysis

    config = EvalConfig((ModelSpec(MODELS["label"], "score", "l_quantity"),), SPECS)
    found = analysis(examples(spark, sf_dir), config, ("l_orderkey", "l_linenumber", "l_partkey"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "label", F.round("prediction", 8).alias("prediction"), "weight", F.array_join("slices", ";").alias("slices"))


@query("evaluated_curves", f"WITH {HIST}{TH200}{CELLS}{STEPS} SELECT slice, 'AUC' AS metric, round(coalesce(sum(CASE WHEN tp2 IS NOT NULL THEN {AREAS['roc_interpolation']} END), 0), 6) AS value FROM p GROUP BY slice UNION ALL SELECT slice, 'RecallAtPrecision@0.2', round(coalesce(max(CASE WHEN ({RATE_SQL['precision']}) >= 0.2 THEN {RATE_SQL['tpr']} END), 0), 6) FROM m GROUP BY slice UNION ALL SELECT slice, 'MeanLabel', round(sum(wl) / sum(w), 6) FROM b GROUP BY slice")
def evaluated_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of curves beside one over sums, by one configuration."""
    config = EvalConfig((ModelSpec(MODELS["label"], "score", "l_quantity"),), SPECS, (MetricConfig("AUC"), MetricConfig("RecallAtPrecision", {"bound": 0.2}), MetricConfig("MeanLabel")))
    return evaluate(examples(spark, sf_dir), config)["metrics"].select("slice", "metric", F.round(null_if_nan(F.col("value")), 6).alias("value"))


CONFIGURED_SQL = f"""WITH {CLASS_CELLS}, v AS (SELECT c, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, tp + fn AS n, tp, fp, fn FROM k)
SELECT 'Precision@0.1' AS metric, 'class:' || c AS sub_key, round(p, 6) AS value FROM v WHERE c IN (1, 4)
UNION ALL SELECT 'Recall@0.1', 'macro', round(avg(r), 6) FROM v UNION ALL SELECT 'Recall@0.1', 'weighted_macro', round(sum(r * n) / sum(n), 6) FROM v
UNION ALL SELECT 'Recall@0.1', 'micro', round(sum(tp) / sum(tp + fn), 6) FROM v UNION ALL SELECT 'ExampleCount', NULL, CAST(count(*) AS DOUBLE) FROM embeddings"""


@query("configured_classes", CONFIGURED_SQL)
def configured_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classes, three kinds of averages and a plain count by one configuration."""
    ten, at = tuple(range(10)), {"threshold": 0.1}
    averages = tuple(MetricConfig("Recall", at, ten, average=how) for how in ("macro", "weighted_macro", "micro"))
    config = EvalConfig((ModelSpec("hot", "prediction"),), (OVERALL,), (MetricConfig("ExampleCount"), MetricConfig("Precision", at, (1, 4)), *averages))
    return evaluate(scored(spark, sf_dir), config)["metrics"].select("metric", "sub_key", F.round(null_if_nan(F.col("value")), 6).alias("value"))


@query("configured_ranking", f"WITH {RANKED}, q AS (SELECT l_orderkey, sum(CASE WHEN n <= 3 THEN l_quantity / log2(n + 1) ELSE 0 END) / sum(CASE WHEN m <= 3 THEN l_quantity / log2(m + 1) ELSE 0 END) AS v, min(CASE WHEN label > 0 THEN n END) AS f FROM r GROUP BY l_orderkey), s AS (SELECT DISTINCT 'l_linestatus:' || l_linestatus AS slice, l_orderkey FROM base UNION ALL SELECT 'Overall', l_orderkey FROM q) SELECT slice, 'NDCG@3' AS metric, round(avg(v), 6) AS value FROM s JOIN q USING (l_orderkey) GROUP BY slice UNION ALL SELECT slice, 'MinLabelPosition', round(avg(f), 6) FROM s JOIN q USING (l_orderkey) GROUP BY slice")
def configured_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics over queries, sliced, by one configuration."""
    metrics = (MetricConfig("NDCG", {"query": "l_orderkey", "gain": "l_quantity", "ks": [3], "order": list(ORDERED)}), MetricConfig("MinLabelPosition", {"query": "l_orderkey", "order": list(ORDERED)}))
    config = EvalConfig((ModelSpec(MODELS["label"], "score"),), SPECS[:2], metrics)
    return evaluate(examples(spark, sf_dir), config)["metrics"].select("slice", "metric", F.round(null_if_nan(F.col("value")), 6).alias("value"))


CURVE_JK = f"""WITH {SLICED}, b AS (
  SELECT slice, {JK} AS g, CAST(CASE WHEN prediction >= 1 THEN 10001 WHEN prediction < 0 THEN 0 ELSE floor(prediction * 10000) + 1 END AS BIGINT) AS bucket, sum(weight) AS w, sum(weight * label) AS wl FROM sl GROUP BY 1, 2, 3){TH200},
c AS (SELECT slice, g, t, sum(CASE WHEN up THEN wl ELSE 0 END) AS tp, sum(CASE WHEN up THEN w - wl ELSE 0 END) AS fp, sum(CASE WHEN up THEN 0 ELSE wl END) AS fn, sum(CASE WHEN up THEN 0 ELSE w - wl END) AS tn
  FROM (SELECT *, bucket > 0 AND (bucket - 1) / CAST(10000 AS DOUBLE) + 1e-12 >= t AS up FROM b, th) GROUP BY 1, 2, 3),
a AS (SELECT slice, t, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM c GROUP BY 1, 2),
m AS (SELECT a.slice, i AS g, a.t, a.tp - coalesce(c.tp, 0) AS tp, a.fp - coalesce(c.fp, 0) AS fp, a.fn - coalesce(c.fn, 0) AS fn, a.tn - coalesce(c.tn, 0) AS tn FROM a CROSS JOIN range(20) r(i) LEFT JOIN c ON c.slice = a.slice AND c.t = a.t AND c.g = i
  UNION ALL SELECT slice, -1, t, tp, fp, fn, tn FROM a),
p AS (SELECT *, lead(tp) OVER o AS tp2, lead(fp) OVER o AS fp2, lead(fn) OVER o AS fn2, lead(tn) OVER o AS tn2 FROM m WINDOW o AS (PARTITION BY slice, g ORDER BY t)),
v AS (SELECT slice, g, coalesce(sum(CASE WHEN tp2 IS NOT NULL THEN {AREAS['roc_interpolation']} END), 0) AS v FROM p GROUP BY 1, 2)
SELECT slice, 'AUC' AS metric, round(max(CASE WHEN g = -1 THEN v END), 6) AS value, round(stddev_samp(CASE WHEN g >= 0 THEN v END) * 19 / sqrt(20), 6) AS standard_error FROM v GROUP BY slice"""


@query("curve_intervals", CURVE_JK)
def curve_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jackknife of an area: a sample's cells are those of all rows less a bucket's."""
    df = examples(spark, sf_dir)
    cells = curves.matrices(curves.histogram(df.withColumn("__b", F.expr(JK)), SPECS, by=["__b"]), curves.interpolated_thresholds(200), by=["__b"])
    found = curves.jackknife(cells, {"AUC": ("ROC", "interpolation")}, samples=20)
    return shown(found, ["value", "standard_error"], keep=("metric",))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long table of common metrics for all slices."""
    config = EvalConfig((ModelSpec(MODELS["label"], "score", "l_quantity"),), SPECS, tuple(MetricConfig(n) for n in ("ExampleCount", "MeanLabel", "MeanPrediction", "Calibration", "BinaryAccuracy", "Precision", "Recall")))
    return evaluate(examples(spark, sf_dir), config)["metrics"].select("slice", "metric", F.round(null_if_nan(F.col("value")), 6).alias("value"))


FLAGSHIP = {"ExampleCount": "w", "MeanLabel": over("wl", "w"), "MeanPrediction": over("wp", "w"), "Calibration": over("wp", "wl")} | {n: POINT_SQL[n] for n in ("BinaryAccuracy", "Precision", "Recall")}
QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = f"WITH {SLICED}, s AS (SELECT slice, sum(weight) AS w, sum(weight * label) AS wl, sum(weight * prediction) AS wp, {cells()} FROM sl GROUP BY slice) " + " UNION ALL ".join(f"SELECT slice, '{n}' AS metric, round({v}, 6) AS value FROM s" for n, v in FLAGSHIP.items())

