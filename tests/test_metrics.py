"""Metrics on small tables with values worked out by hand, and the odd cases: NaN, nothing in the denominator, no rows."""

import math

import pytest
from pyspark.sql import functions as F

from metricloom.functions import inputs
from metricloom.functions.scalars import t_quantile
from metricloom.operators import curves
from metricloom.operators.metrics import REGISTRY, make, register
from metricloom.plans.config import EvalConfig, MetricConfig, ModelSpec
from metricloom.plans.evaluate import wide


@pytest.fixture(scope="module")
def values(spark):
    def run(rows, *metrics, models=(ModelSpec("label", "prediction", "weight"),), schema="label double, prediction double, weight double", **params):
        configs = tuple(m if isinstance(m, MetricConfig) else MetricConfig(m, params) for m in metrics)
        return wide(spark.createDataFrame(rows, schema), EvalConfig(models, metrics=configs)).first()

    return run


PLAIN = [(0.0, 0.0, 1.0), (1.0, 0.3, 1.0), (1.0, 0.9, 1.0)]
WEIGHTED = [(0.0, 1.0, 0.5), (1.0, 0.7, 0.7), (0.0, 0.5, 0.9)]


def test_means(values):
    r = values(PLAIN, "MeanLabel", "MeanPrediction", "Calibration", "ExampleCount")
    assert (r.MeanLabel, r.MeanPrediction, r.Calibration, r.ExampleCount) == pytest.approx((2 / 3, 0.4, 0.6, 3))
    r = values(WEIGHTED, "MeanLabel", "MeanPrediction", "Calibration")
    assert tuple(r)[1:] == pytest.approx((0.7 / 2.1, 1.44 / 2.1, 1.44 / 0.7))
    r = values([(0.0, 0.5, None)], "Calibration", "ExampleCount", "MeanPrediction")
    assert math.isnan(r.Calibration) and r.ExampleCount == 1 and r.MeanPrediction == 0.5


def test_points_of_a_known_matrix(values):
    rows = [(1.0, 0.9, 1.0)] * 1 + [(0.0, 0.1, 1.0)] * 2 + [(0.0, 0.9, 1.0)] * 3 + [(1.0, 0.1, 1.0)] * 4
    tp, tn, fp, fn = 1.0, 2.0, 3.0, 4.0
    wanted = {
        "TruePositives": tp, "TrueNegatives": tn, "FalsePositives": fp, "FalseNegatives": fn, "BinaryAccuracy": 0.3, "Precision": 0.25, "Recall": 0.2, "Specificity": 0.4, "FallOut": 0.6, "MissRate": 0.8,
        "NegativePredictiveValue": 2 / 6, "FalseDiscoveryRate": 0.75, "FalseOmissionRate": 4 / 6, "Prevalence": 0.5, "ThreatScore": 1 / 8, "BalancedAccuracy": 0.3, "F1Score": 2 / 9,
        "MatthewsCorrelationCoefficient": (2 - 12) / math.sqrt(4 * 5 * 5 * 6), "FowlkesMallowsIndex": math.sqrt(0.25 * 0.2), "Informedness": -0.4, "Markedness": 0.25 + 2 / 6 - 1,
        "PositiveLikelihoodRatio": 0.2 / 0.6, "NegativeLikelihoodRatio": 0.8 / 0.4, "DiagnosticOddsRatio": (1 / 4) / (3 / 2), "PredictedPositiveRate": 0.4,
        "PrevalenceThreshold": (math.sqrt(0.2 * (1 - 0.4)) + 0.4 - 1) / (0.2 + 0.4 - 1),
    }
    r = values(rows, *wanted)
    assert {n: r[n] for n in wanted} == pytest.approx(wanted)


def test_weighted_matrix_and_aliases(values):
    rows = [(0.0, 1.0, 0.5), (1.0, 0.7, 0.7), (0.0, 0.5, 0.9)]
    r = values(rows, "TP", "TN", "FP", "FN", "Prevalence", "ThreatScore", "F1Score")
    assert tuple(r)[1:] == pytest.approx((0.7, 0.9, 0.5, 0.0, 0.7 / 2.1, 0.7 / 1.2, 1.4 / 1.9))


def test_fractional_labels(values):
    r = values([(0.3, 0.9, 2.0)], "TP", "FP")
    assert (r.TruePositives, r.FalsePositives) == pytest.approx((0.6, 1.4))


def test_nothing_to_divide_by(values):
    r = values([(1.0, 1.0, 1.0)], "Specificity", "FallOut", "MatthewsCorrelationCoefficient", "DiagnosticOddsRatio", "PositiveLikelihoodRatio", "Recall")
    assert all(math.isnan(x) for x in tuple(r)[1:-1]) and r.Recall == 1


def test_errors_and_losses(values):
    rows = [(1.0, 0.5, 1.0), (3.0, 5.0, 2.0), (0.0, 1.0, 1.0), (float("nan"), 1.0, 5.0)]
    r = values(rows, "MeanAbsoluteError", "MeanSquaredError", "MeanAbsolutePercentageError", "MeanSquaredLogarithmicError")
    assert r.MeanAbsoluteError == pytest.approx((0.5 + 4 + 1) / 4) and r.MeanSquaredError == pytest.approx((0.25 + 8 + 1) / 4)
    assert r.MeanAbsolutePercentageError == pytest.approx((50 + 2 * 200 / 3) / 3)
    assert r.MeanSquaredLogarithmicError == pytest.approx(sum(w * (math.log(a + 1) - math.log(b + 1)) ** 2 for a, b, w in rows[:3]) / 4)
    r = values([(1.0, 0.8, 1.0), (0.0, 0.4, 1.0)], "BinaryCrossEntropy")
    assert r.BinaryCrossEntropy == pytest.approx(-(math.log(0.8) + math.log(0.6)) / 2)
    assert values([(1.0, 0.0, 1.0)], "BinaryCrossEntropy").BinaryCrossEntropy == math.inf
    assert values([(1.0, 1.0, 1.0)], "BinaryCrossEntropy").BinaryCrossEntropy == 0
    logit = values([(1.0, 2.0, 1.0)], MetricConfig("BinaryCrossEntropy", {"from_logits": True}))
    assert logit.BinaryCrossEntropy == pytest.approx(math.log1p(math.exp(-2)))


def test_correlation_and_discrimination(values):
    rows = [(1.0, 0.9, 1.0), (0.0, 0.2, 2.0), (1.0, 0.6, 1.0), (0.0, 0.4, 1.0)]
    r = values(rows, "SquaredPearsonCorrelation", "CoefficientOfDiscrimination", "RelativeCoefficientOfDiscrimination")
    n, x, y = sum(w for *_, w in rows), sum(a * w for a, _, w in rows), sum(b * w for _, b, w in rows)
    xy, xx, yy = (sum(f(a, b) * w for a, b, w in rows) for f in (lambda a, b: a * b, lambda a, b: a * a, lambda a, b: b * b))
    assert r.SquaredPearsonCorrelation == pytest.approx((xy - x * y / n) ** 2 / ((xx - x * x / n) * (yy - y * y / n)))
    assert r.CoefficientOfDiscrimination == pytest.approx(0.75 - 0.8 / 3) and r.RelativeCoefficientOfDiscrimination == pytest.approx(0.75 / (0.8 / 3))


def test_exact_match(values):
    rows = [("a", "a"), ("b", "c"), ('{"x": 1}', '{"x":1} ')]
    model = (ModelSpec("label", "prediction"),)
    assert values(rows, "ExactMatch", models=model, schema="label string, prediction string").ExactMatch == pytest.approx(1 / 3)
    rows = [('{"a": 1, "b": 2}', '{"b": 2, "a": 1}'), ("[1]", "[2]"), ("no json", "no json")]
    assert values(rows, MetricConfig("ExactMatch", {"convert_to": "json"}), models=model, schema="label string, prediction string").ExactMatch == pytest.approx(1 / 3)


def test_two_models(values):
    models = (ModelSpec("0D", "a", "weight", "base", True), ModelSpec("0D", "b", "weight", "new"))
    rows = [(0.1, 0.2, 0.3), (0.1, 0.9, 0.1), (0.9, 0.1, 0.2), (0.8, 0.9, 0.4)]
    names = ["NegToNegFlipRate", "NegToPosFlipRate", "PosToNegFlipRate", "PosToPosFlipRate", "SymmetricFlipRate"]
    r = values(rows, *names, models=models, schema="a double, b double, weight double")
    assert [r[f"new/{n}"] for n in names] == pytest.approx([0.3, 0.1, 0.2, 0.4, 0.3])
    r = values([(0.0, 0.0, 1.0), (1.0, 3.0, 1.0)], "SymmetricPredictionDifference", models=models, schema="a double, b double, weight double")
    assert r["new/SymmetricPredictionDifference"] == pytest.approx((0 + 2 * 2 / 4) / 2)
    r = values([([1.0, 0.0], [1.0, 1.0], 1.0), ([2.0, 0.0], [3.0, 0.0], 1.0)], "ModelCosineSimilarity", models=models, schema="a array<double>, b array<double>, weight double")
    assert r["new/ModelCosineSimilarity"] == pytest.approx((1 / math.sqrt(2) + 1) / 2)
    with pytest.raises(ValueError, match="baseline"):
        values(rows, "SymmetricFlipRate", models=(ModelSpec("0D", "a"),), schema="a double, b double, weight double")


def test_users_own_metric(values):
    from metricloom.operators.metrics import WEIGHT, Metric

    @register("LargestPrediction")
    def largest():
        return Metric("LargestPrediction", WEIGHT | {"max p": lambda r: r.prediction}, lambda s: s["max p"], {"max p": "max"})

    assert values(PLAIN, "LargestPrediction").LargestPrediction == 0.9
    del REGISTRY["LargestPrediction"]
    with pytest.raises(ValueError, match="unknown metric"):
        make("LargestPrediction")


def brute_auc(rows):
    pairs = [(wa * wb, (pa > pb) + 0.5 * (pa == pb)) for la, pa, wa in rows if la for lb, pb, wb in rows if not lb]
    return sum(w * x for w, x in pairs) / sum(w for w, _ in pairs)


def test_curves(spark):
    import random

    rng = random.Random(1)
    rows = [(float(rng.random() < 0.4), rng.randrange(1000) / 1000 + 0.0005, float(rng.randrange(1, 4))) for _ in range(400)]
    frame = spark.createDataFrame([*rows, (1.0, None, 1.0), (1.0, float("nan"), 1.0)], "label double, prediction double, weight double")
    hist = curves.histogram(frame)
    rows.append((1.0, -1.0, 1.0))  # NaN is below every threshold, a null prediction isn't there
    assert hist.agg(F.sum("w")).first()[0] == sum(w for *_, w in rows)
    many = curves.matrices(hist, [i / 10_000 for i in range(-1, 10_002)])
    assert curves.auc(many).first().value == pytest.approx(brute_auc(rows), abs=1e-6)
    few = curves.matrices(hist, [0.1, 0.5, 0.9])
    exact = {r.threshold: r for r in curves.exact_matrices(frame, [0.1, 0.5, 0.9]).collect()}
    for r in few.collect():
        assert (r.tp, r.fp, r.fn, r.tn) == (exact[r.threshold].tp, exact[r.threshold].fp, exact[r.threshold].fn, exact[r.threshold].tn)
    cells = curves.matrices(hist, curves.interpolated_thresholds(200))
    low, mid, high = (curves.auc(cells, "ROC", m).first().value for m in ("minoring", "interpolation", "majoring"))
    assert low < mid < high and abs(mid - brute_auc(rows)) < 0.01
    got = curves.constrained(cells, "RecallAtPrecision", [0.0, 2.0]).collect()
    assert {r.bound: r.value for r in got} == {0.0: pytest.approx(1 - 1 / sum(w for y, _, w in rows if y)), 2.0: 0.0}
    plot = {round(r.lower, 3): r for r in curves.calibration_plot(hist, points=10).collect()}
    assert sum(r.w for r in plot.values()) == sum(w for *_, w in rows)


def test_inputs(spark):
    row = spark.createDataFrame([([0.1, 0.7, 0.2, 0.7], [0.0, 1.0, 0.0, 0.0], 2)], "p array<double>, l array<double>, c int")
    best = inputs.top_k(F.col("p"), F.col("l"), 2)
    r = row.select(
        inputs.one_hot(F.col("c"), F.lit(3)), inputs.sparse_to_dense(F.array(F.lit(0), F.lit(2)), F.lit(3)), inputs.at_class(F.col("p"), 2), F.struct(*inputs.kth(F.col("p"), F.col("l"), 3)), inputs.keep_top_k(F.col("p"), 1), best[0], best[1],
        inputs.padded(F.col("p"), 6, -1.0), inputs.invert_log2(F.lit(3.0)), inputs.invert_log2(F.lit(3.0), 5.0), inputs.class_index(F.lit("x"), ["y"]),
    ).first()
    assert r[0] == [0, 0, 1] and r[1] == [1, 0, 1] and r[2] == 0.2 and tuple(r[3]) == (0.2, 0.0) and r[4] == [-math.inf, 0.7, -math.inf, -math.inf]
    assert r[5] == [0.7, 0.7] and r[6] == [1, 0] and r[7][4:] == [-1, -1] and (r[8], r[9], r[10]) == (7, 5, -1)
    rows = inputs.class_rows(row.withColumns({"label": F.col("l"), "prediction": F.col("p"), "weight": F.lit(1.0)}), class_weights={1: 3.0}).collect()
    assert [(x.class_id, x.label, x.weight) for x in rows] == [(0, 0, 0), (1, 1, 3), (2, 0, 0), (3, 0, 0)]
    with pytest.raises(Exception, match="fractional"):
        spark.range(1).select(inputs.check_fractional(F.lit(1.5))).collect()
    nested = spark.createDataFrame([((0.5, 0.6),)], "p struct<other: double, scores: double>")
    assert nested.select(inputs.resolve_prediction(nested, "p")).first()[0] == 0.6 and nested.select(inputs.resolve_prediction(nested, "p", "other")).first()[0] == 0.5
    with pytest.raises(ValueError, match="no prediction"):
        inputs.resolve_prediction(nested, "p", "none")


def test_t_quantile():
    assert t_quantile(0.975, 19) == pytest.approx(2.093024054408263, abs=1e-10)
    assert t_quantile(0.975, 1) == pytest.approx(12.706204736, abs=1e-6)
    assert t_quantile(0.025, 5) == pytest.approx(-2.570581836, abs=1e-8)
