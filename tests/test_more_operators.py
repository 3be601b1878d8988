"""Classes, sets, pixels, attributions, samples, rankings, boxes and texts on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions import boxes, texts
from metricloom.operators import curves, detection, multiclass, ranking, textscores
from metricloom.operators.slicing import OVERALL, SlicingSpec


def test_multiclass_confusion(spark):
    rows = [(2, [0.2, 0.3, 0.5], 0.5), (0, [0.1, 0.3, 0.6], 1.0), (1, [0.3, 0.1, 0.6], 0.25), (1, [0.1, 0.9, 0.0], 2.0), (2, [0.1, 0.2, 0.7], 1.0)]
    df = spark.createDataFrame(rows, "label int, prediction array<double>, weight double")
    got = {(r.actual, r.predicted): r.w for r in multiclass.confusion(df).collect()}
    assert got == {(0, 2): 1.0, (1, 1): 2.0, (1, 2): 0.25, (2, -1): 0.5, (2, 2): 1.0}
    dense = df.withColumn("label", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (i == F.col("label")).cast("double")))
    assert {(r.actual, r.predicted): r.w for r in multiclass.confusion(dense).collect()} == got


def test_averages_over_classes(spark):
    cells = spark.createDataFrame([([], 0, 8.0, 2.0, 2.0, 8.0), ([], 1, 1.0, 3.0, 0.0, 16.0), ([], 2, 0.0, 0.0, 10.0, 10.0)], "slice_key array<struct<key: string, value: string>>, class_id int, tp double, fp double, fn double, tn double")
    recall = F.try_divide("tp", F.col("tp") + F.col("fn"))
    value = lambda *a: multiclass.average(cells, recall, *a).first().value
    assert value("macro") == pytest.approx((0.8 + 1 + 0) / 3) and value("micro") == pytest.approx(9 / 21) and value("weighted_macro") == pytest.approx((0.8 * 10 + 1) / 21)
    assert value("macro", {0: 1.0, 1: 3.0}) == pytest.approx(3.8 / 4) and value("micro", {1: 1.0}) == 1.0 and math.isnan(value("macro", {9: 1.0}))
    out = spark.createDataFrame([([], "m", "a", 1.0), ([], "m", "b", 4.0)], "slice_key array<string>, metric string, output string, value double")
    assert multiclass.output_average(out, {"a": 1.0, "b": 2.0}).first().value == pytest.approx(3.0)


def test_multi_label(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0], [0.9, 0.1, 0.8], 1.0)], "label array<double>, prediction array<double>, weight double")
    got = {(r.actual, r.predicted): (r.tp, r.fp, r.fn, r.tn) for r in multiclass.multi_label(df).collect()}
    assert got == {(a, p): c for a in (0, 1) for p, c in ((0, (1, 0, 0, 0)), (1, (0, 0, 1, 0)), (2, (0, 1, 0, 0)))}


def test_set_matches(spark):
    rows = [(["a", "b", "c"], ["a", "x", "b"], [0.9, 0.8, 0.1], {"a": 2.0}), (["a"], [], [], None)]
    df = spark.createDataFrame(rows, "labels array<string>, classes array<string>, scores array<double>, w map<string, double>").withColumn("weight", F.lit(1.0))
    got = sorted((r.item, r.label, r.prediction) for r in multiclass.set_matches(df).collect())
    low = -math.inf
    assert got == [("a", 1, low), ("a", 1, 0.9), ("b", 1, 0.1), ("c", 1, low), ("x", 0, 0.8)]
    top = sorted((r.item, r.label, r.prediction, r.weight) for r in multiclass.set_matches(df, top_k=1, class_weights="w").where("w is not null").collect())
    assert top == [("a", 1, 0.9, 2), ("b", 1, low, 1), ("c", 1, low, 1)]


def test_segmentation(spark):
    df = spark.createDataFrame([([1, 1, 2, 0], [1, 2, 2, 1], "x"), ([2], [2], "y")], "truth array<int>, predicted array<int>, g string")
    got = {r.class_id: (r.tp, r.fp, r.fn, r.tn) for r in multiclass.segmentation(df, [1, 2], ignore=0).collect()}
    assert got == {1: (1, 0, 1, 2), 2: (2, 1, 0, 1)}
    assert multiclass.segmentation(df, [1], specs=(SlicingSpec(("g",)),)).count() == 2


def test_attributions(spark):
    df = spark.createDataFrame([({"f": 1.0, "g": -2.0}, 1.0), ({"f": -3.0}, 2.0)], "a map<string, double>, w double")
    run = lambda *a, **k: {r.feature: r.value for r in multiclass.attributions(df, "a", *a, **k).collect()}
    assert run() == {"f": -2, "g": -2} and run(True) == {"f": 4, "g": 2} and run(False, True) == {"f": -1, "g": -1} and run(True, True, weight="w") == pytest.approx({"f": 7 / 3, "g": 2 / 3})
    by_class = spark.createDataFrame([({"f": [1.0, 5.0]},)], "a map<string, array<double>>")
    assert multiclass.attributions(by_class, "a", class_id=1).first().value == 5


def test_samples(spark):
    df = spark.range(1000).withColumn("w", F.when(F.col("id") < 10, 1000.0).otherwise(0.001))
    one = multiclass.fixed_sample(df, "id", 10, weight="w").first()["values"]
    assert sum(x < 10 for x in one) >= 9 and one == multiclass.fixed_sample(df.repartition(7), "id", 10, weight="w").first()["values"]
    assert len(set(multiclass.fixed_sample(df, "id", 50, seed=1).first()["values"])) == 50
    wrong = spark.createDataFrame([(f"v{i}", 0.9, 0.0) for i in range(30)] + [("fn", 0.1, 1.0)], "f string, prediction double, label double")
    assert len(curves.feature_sample(wrong, "f", "fp").first()["values"]) == 10 and curves.feature_sample(wrong, "f", "fn").first()["values"] == ["fn"]


RANKED = [("q1", 1.0, 0.8, 1.0), ("q1", 0.0, 0.2, 0.0), ("q2", 0.0, 0.5, 0.5), ("q2", 1.0, 0.4, 1.0), ("q2", 0.0, 0.1, 0.0), ("q3", 0.0, 0.5, 0.0), ("q3", 0.0, 0.4, 0.0)]


def test_ranking(spark):
    df = spark.createDataFrame(RANKED, "query string, label double, prediction double, gain double")
    got = {r.k: r.value for r in ranking.ndcg(df, "query", "gain", (1, 2)).collect()}
    assert got[1] == pytest.approx((1 + 0.5) / 2)
    assert got[2] == pytest.approx((1 + (0.5 + 1 / math.log2(3)) / (1 + 0.5 / math.log2(3))) / 2)
    assert ranking.min_label_position(df, "query").first().value == pytest.approx(1.5)
    s = ranking.query_statistics(df.withColumn("w", F.lit(2.0)), "query", "w").first()
    assert (s.total_queries, s.total_documents, s.min_documents, s.max_documents) == (6, 14, 4, 6)
    with pytest.raises(Exception, match="differ in weight"):
        ranking.query_statistics(df, "query", "gain").collect()
    grouped = {r.query: r for r in ranking.group_by_query(df.withColumn("query", F.when(F.col("query") != "q1", F.col("query"))), "query", ["label"], (OVERALL,)).collect()}
    assert set(grouped) == {"", "q2", "q3"} and len(grouped["q2"].rows) == 3


def plain_match(truth, found, iou):
    free, rows = dict(enumerate(truth)), []
    for d in sorted(found, key=lambda d: -d[5]):
        scored = [(boxes.overlaps(np.array([d]), np.array([t]))[0, 0], j) for j, t in free.items() if boxes.overlaps(np.array([d]), np.array([t]))[0, 0] >= iou]
        if scored:
            free.pop(max(scored)[1])
            rows.append((1.0, d[5]))
        else:
            rows.append((0.0, d[5]))
    return rows + [(1.0, 0.0)] * len(free)


def test_boxes(spark, monkeypatch):
    rng = random.Random(1)
    box = lambda: [x := rng.randrange(20), y := rng.randrange(20), x + rng.randrange(1, 15), y + rng.randrange(1, 15)]
    for many in (400, 0):
        monkeypatch.setattr(boxes, "PAIRS", many)
        for _ in range(40):
            truth = [[*map(float, box()), 0.0] for _ in range(rng.randrange(6))]
            found = [[*map(float, box()), 0.0, rng.random()] for _ in range(rng.randrange(6))]
            assert boxes.matches(truth, found, (0.1, 0.5)) == [plain_match(truth, found, i) for i in (0.1, 0.5)]
    truth = [[0.0, 0.0, 10.0, 10.0, 1.0], [0.0, 0.0, 2.0, 2.0, 1.0]]
    found = [[0.0, 0.0, 10.0, 9.0, 1.0, 0.9], [50.0, 50.0, 52.0, 52.0, 1.0, 0.8], [0.0, 0.0, 9.0, 9.0, 2.0, 0.7]]
    df = spark.createDataFrame([("x", truth, found), ("y", None, [])], "g string, truth array<array<double>>, found array<array<double>>")
    rows = detection.matched(df, classes=(1, None))
    assert sorted((r.label, r.prediction) for r in rows.where("class_id = 1").collect()) == [(0, 0.8), (1, 0.0), (1, 0.9)]
    assert rows.where("class_id is null").count() == 4
    big = detection.matched(df, classes=(1,), area=(50.0, 1e9)).collect()
    assert [(r.label, r.prediction) for r in big] == [(1, 0.9)]
    assert detection.average_precision(rows.where("class_id = 1")).first().value == pytest.approx(51 / 101)
    assert detection.average_recall(rows.where("class_id = 1")).first().value == 0.5
    assert detection.mean_over(detection.average_recall(rows)).count() == 1
    z = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], 1)], "a array<double>, b array<double>, n int")
    assert z.select(detection.stacked(["a", "b"], "n")).first()[0] == [[1.0, 3.0]]


def test_bleu(spark):
    rows = [("the cat sat on the mat", ["the cat sat on the mat"]), ("a dog", ["a dog barks", "the dog"])]
    df = spark.createDataFrame(rows, "hypothesis string, references array<string>")
    m, t = [6 + 2, 5 + 1, 4, 3], [8, 6, 4, 3]
    p = [100 * a / b for a, b in zip(m, t, strict=True)]
    r = textscores.bleu(df).first()
    assert (r.hypothesis_length, r.reference_length) == (8, 8) and r.value == pytest.approx(math.exp(sum(map(math.log, p)) / 4)) == pytest.approx(100)
    part = spark.createDataFrame([("the cat", ["the cat sat on the mat"])], "hypothesis string, references array<string>")
    brevity = math.exp(1 - 6 / 2)
    assert textscores.bleu(part, effective_order=True).first().value == pytest.approx(100 * brevity) and textscores.bleu(part, smooth="none").first().value == 0
    none = spark.createDataFrame([("x y z w v", ["a b c d e"])], "hypothesis string, references array<string>")
    assert textscores.bleu(none).first().value == pytest.approx(math.exp(sum(math.log(100 / (2**k * n)) for k, n in ((1, 5), (2, 4), (3, 3), (4, 2))) / 4))
    assert textscores.bleu(none, smooth="floor").first().value == pytest.approx(math.exp(sum(math.log(10 / n) for n in (5, 4, 3, 2)) / 4))
    assert texts.tokens("Hello, world! 3.5% of $2-3.") == ["Hello", ",", "world", "!", "3.5", "%", "of", "$", "2", "-", "3", "."]
    assert texts.tokens("你好 world", "zh") == ["你", "好", "world"] and texts.tokens("a-b “c”", "intl") == ["a", "-", "b", "“", "c", "”"] and texts.tokens("A b", "none", True) == ["a", "b"]
    with pytest.raises(ValueError):
        texts.tokens("x", "other")


def test_rouge(spark):
    assert texts.rouge("the cat sat", "the cat was here", "rouge1") == pytest.approx((2 / 3, 2 / 4, 4 / 7))
    assert texts.rouge("the cat sat", "the cat was here", "rouge2") == pytest.approx((1 / 2, 1 / 3, 0.4))
    assert texts.rouge("a c b d", "a b c d", "rougeL")[0] == pytest.approx(3 / 4) and texts.rouge("", "a", "rougeL") == (0, 0, 0)
    assert texts.rouge("w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5", "rougeLsum")[1] == pytest.approx(4 / 5)
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert texts.common_length(a, b) == texts.longest_common(a, b)[-1][-1]
    df = spark.createDataFrame([("the cat", ["the cat", "dog"], 1.0), ("x", ["y"], 3.0), (None, None, 0.0)], "hypothesis string, references array<string>, w double")
    assert textscores.rouge(df, "rouge1", weight="w").first().fmeasure == pytest.approx(0.25)
    with pytest.raises(ValueError):
        texts.rouge("a", "b", "rouge0")
    words = spark.createDataFrame([("The cat, the CAT's hat!",)], "t string").select(textscores.plain_words(F.col("t"))).first()[0]
    assert words == ["the", "cat", "cats", "hat"] == texts.plain_words("The cat, the CAT's hat!")
