"""Slices, plans, validation, files and streams."""

import math

import pytest
from pyspark.sql import functions as F

from metricloom.operators import confidence, curves, slicing, validation
from metricloom.operators.slicing import OVERALL, SlicingSpec
from metricloom.plans.config import CrossSlicingSpec, EvalConfig, MetricConfig, ModelSpec, Options, binary_metrics, multiclass_metrics, regression_metrics
from metricloom.plans.evaluate import evaluate, lookup, pivoted
from metricloom.sources.results import read_examples, read_results, read_runs, write_results
from metricloom.streaming.incremental import running_metrics

SCHEMA = "gender string, age int, fruits array<string>, label double, prediction double, weight double"
ROWS = [("f", 13, ["kiwi", "apple", "kiwi"], 1.0, 0.9, 1.0), ("m", 13, [], 0.0, 0.8, 2.0), ("f", None, ["apple"], 1.0, 0.2, 1.0), ("f", 13, None, 0.0, 0.1, 3.0)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def names(frame, *specs):
    return sorted(r.n for r in slicing.fan_out(frame, specs).select(slicing.slice_name(F.col("slice_key")).alias("n")).collect())


def test_keys_values_and_products(frame):
    assert names(frame) == ["Overall"] * 4
    assert names(frame, SlicingSpec(("gender",))) == ["gender:f"] * 3 + ["gender:m"]
    assert names(frame, SlicingSpec(("age", "gender"))) == ["age_X_gender:13_X_f"] * 2 + ["age_X_gender:13_X_m"]
    assert names(frame, SlicingSpec(("fruits",))) == ["fruits:apple"] * 2 + ["fruits:kiwi"]
    assert names(frame, SlicingSpec(("fruits", "gender"), {"age": 13})) == ["age_X_fruits_X_gender:13_X_apple_X_f", "age_X_fruits_X_gender:13_X_kiwi_X_f"]
    assert names(frame, SlicingSpec((), {"age": "13"})) == ["age:13"] * 3 and names(frame, SlicingSpec((), {"fruits": "apple"})) == ["fruits:apple"] * 2
    assert names(frame, SlicingSpec(("gender",)), SlicingSpec(("gender",))) == ["gender:f"] * 3 + ["gender:m"]
    with pytest.raises(ValueError, match="not both"):
        SlicingSpec(("age",), {"age": 1})


def test_sql(frame):
    sql = lambda s: names(frame, SlicingSpec(sql=s))
    assert sql("SELECT STRUCT(example.gender) WHERE example.age = 13") == ["gender:f"] * 2 + ["gender:m"]
    assert sql("SELECT STRUCT(fruits AS fruit, example.gender) FROM example.fruits WHERE fruits != 'kiwi'") == ["fruit_X_gender:apple_X_f"] * 2
    assert sql("SELECT STRUCT('yes' AS kiwi) WHERE 'kiwi' IN UNNEST(example.fruits)") == ["kiwi:yes"]
    assert sql("select struct(example.age > 10 as old)") == ["old:true"] * 3
    with pytest.raises(ValueError, match="doesn't tell"):
        slicing.sql_slice_keys("DELETE FROM x")


def test_applies(spark):
    key = [("a", "1"), ("b", "2")]
    one = spark.createDataFrame([(key,)], f"k {slicing.KEY}")
    ok = lambda s: one.select(slicing.applies(F.col("k"), s)).first()[0]
    assert ok(SlicingSpec(("a", "b"))) and ok(SlicingSpec(("a",), {"b": 2})) and not ok(SlicingSpec(("a",))) and not ok(SlicingSpec(("a",), {"b": 3})) and not ok(OVERALL)


def test_presummed_slices_equal_plain_ones(frame):
    specs = (OVERALL, SlicingSpec(("gender",)), SlicingSpec(("fruits", "age")))
    got = slicing.grouped_sums(frame, specs, {"w": F.col("weight"), "m": F.col("prediction")}, kinds={"m": "max"})
    plain = slicing.fan_out(frame, specs).groupBy("slice_key").agg(F.sum("weight").alias("w"), F.max("prediction").alias("m"))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_evaluation_of_two_models(frame):
    models = (ModelSpec("label", "prediction", "weight", "new"), ModelSpec("label", "1 - prediction", "weight", "old", True))
    config = EvalConfig(models, (OVERALL, SlicingSpec(("gender",))), (MetricConfig("MeanPrediction"), MetricConfig("SymmetricFlipRate")), (CrossSlicingSpec(OVERALL),), options=Options(min_slice_size=2))
    out = evaluate(frame, config)
    got = {(r.slice, r.model, r.metric): r for r in out["metrics"].collect()}
    new = (0.9 + 1.6 + 0.2 + 0.3) / 7
    assert got["Overall", "new", "MeanPrediction"].value == pytest.approx(new) and got["Overall", "new", "MeanPrediction"].change == pytest.approx(2 * new - 1)
    assert got["Overall", "old", "MeanPrediction"].change is None and got["Overall", "new", "SymmetricFlipRate"].change is None
    assert ("Overall", "old", "SymmetricFlipRate") not in got
    assert got["gender:m", "new", "MeanPrediction"].value is None and "fewer than 2 rows" in got["gender:m", "new", "MeanPrediction"].error
    crossed = [r for r in out["cross_slices"].collect() if r.model == "new" and r.metric == "MeanPrediction" and r.value is not None]
    assert len(crossed) == 1 and crossed[0].value == pytest.approx(new - 1.4 / 5)
    table = {(r.slice, r.model): r for r in pivoted(out["metrics"], ["MeanPrediction"]).collect()}
    assert table["Overall", "new"].MeanPrediction == pytest.approx(new)
    assert {r.slice for r in lookup(out["metrics"], SlicingSpec(("gender",))).collect()} == {"gender:f", "gender:m"}


def test_config_checks_and_json():
    config = EvalConfig((ModelSpec(name="a", is_baseline=True), ModelSpec(name="b")), (SlicingSpec(("x",), {"y": 1}), SlicingSpec(sql="SELECT STRUCT(example.x)")), binary_metrics(), (CrossSlicingSpec(OVERALL, (SlicingSpec(("x",)),)),), (validation.Threshold("AUC", 0.5, direction="higher", absolute=0.0),), Options(2, "jackknife", identity=("id",)))
    assert EvalConfig.from_json(config.to_json()) == config == config.verified()
    assert {m.name for m in regression_metrics() + multiclass_metrics()} >= {"MeanSquaredError", "SparseCategoricalAccuracy"}
    for bad in (EvalConfig(()), EvalConfig((ModelSpec(), ModelSpec())), EvalConfig((ModelSpec(name="a", is_baseline=True), ModelSpec(name="b", is_baseline=True))), EvalConfig(options=Options(intervals="x")), EvalConfig(thresholds=(validation.Threshold("m", direction="lower"),))):
        with pytest.raises(ValueError):
            bad.verified()


def test_validation(spark, frame):
    models = (ModelSpec("label", "prediction", "weight", "new"), ModelSpec("label", "0D", "weight", "old", True))
    t = validation.Threshold
    thresholds = (
        t("MeanPrediction", 0.1, 0.9, model="new"), t("MeanPrediction", upper=0.1, model="new"), t("MeanPrediction", direction="higher", absolute=0.1, model="new"), t("MeanPrediction", direction="lower", absolute=0.1, model="new"),
        t("MeanPrediction", direction="higher", relative=0.1, model="new"), t("Nothing", 0.1, model="new"), t("Calibration", 0.0, spec=SlicingSpec(("age",)), model="new"),
    )
    out = evaluate(frame, EvalConfig(models, (OVERALL,), (MetricConfig("MeanPrediction"), MetricConfig("Calibration")), thresholds=thresholds))["validations"]
    rows = {r.threshold: r for r in out.collect()}
    assert [rows[i].ok for i in range(7)] == [True, False, True, False, False, False, False]
    assert rows[5].message == rows[6].message == "no result for this threshold"
    v = validation.verdict(out)
    assert tuple(v.first()) == (False, 5, 2) and tuple(validation.merge([v, v]).first()) == (False, 10, 4)
    with pytest.raises(ValueError, match="unseen"):
        validation.validate(out, [])


def test_jackknife_and_bootstrap(spark):
    rows = [(i, float(i % 3 == 0), (i % 17) / 17, 1.0 + i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label double, prediction double, weight double")
    config = lambda how: EvalConfig((ModelSpec("label", "prediction", "weight"),), metrics=(MetricConfig("MeanLabel"), MetricConfig("Precision")), options=Options(intervals=how, identity=("id",)))
    for how in ("jackknife", "bootstrap"):
        got = {r.metric: r for r in evaluate(df, config(how))["metrics"].collect()}
        mean = sum(a * w for _, a, _, w in rows) / sum(w for *_, w in rows)
        assert got["MeanLabel"].value == pytest.approx(mean) and got["MeanLabel"].lower < mean < got["MeanLabel"].upper
        assert 0.01 < got["MeanLabel"].standard_error < 0.06 and got["Precision"].samples == 20
    by_hand = []
    for b in range(20):
        kept = [r for r in rows if r[0] % 20 != b]
        by_hand.append(sum(a * w for _, a, _, w in kept) / sum(w for *_, w in kept))
    pseudo = [20 * mean - 19 * x for x in by_hand]
    m = sum(pseudo) / 20
    se = math.sqrt(sum((p - m) ** 2 for p in pseudo) / 19 / 20)
    w, a = F.col("weight"), F.col("label")
    r = confidence.jackknife(df, {"w": w, "wl": w * a}, {"MeanLabel": lambda s: s["wl"] / s["w"]}, F.col("id") % 20).first()
    assert r.standard_error == pytest.approx(se) and r.sample_mean == pytest.approx(sum(by_hand) / 20)
    few = confidence.jackknife(df.where("id < 1"), {"w": w, "wl": w * a}, {"MeanLabel": lambda s: F.when(s["w"] > 0, s["wl"] / s["w"]).otherwise(float("nan"))}, F.col("id") % 20).first()
    assert few.lower is None and few.value == 1.0
    counts = spark.range(20_000).select(confidence.poisson_counts(confidence.hashed_uniform(["id"])(3)).alias("c")).agg(F.avg("c"), F.variance("c")).first()
    assert counts[0] == pytest.approx(1, abs=0.03) and counts[1] == pytest.approx(1, abs=0.05)


def test_files(spark, frame, tmp_path):
    config = EvalConfig((ModelSpec("label", "prediction", "weight"),), (OVERALL,), (MetricConfig("MeanLabel"),))
    out = evaluate(frame, config)
    for run in "ab":
        write_results(out, config, str(tmp_path / run))
    again, found = read_results(spark, str(tmp_path / "a"))
    assert again == config and found["metrics"].collect() == out["metrics"].collect()
    assert {r.run for r in read_runs(spark, {r: str(tmp_path / r) for r in "ab"}).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        write_results({}, config, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        read_runs(spark, {})
    frame.drop("fruits").write.csv(str(tmp_path / "csv"))
    assert read_examples(spark, str(tmp_path / "csv"), "csv", "gender string, age int, label double, prediction double, weight double").count() == 4
    for bad in ("avro", "csv"):
        with pytest.raises(ValueError):
            read_examples(spark, "x", bad)


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 3.0), ("2024-01-01 00:01:10", "b", 5.0)]
    frame = spark.createDataFrame(rows, "t string, g string, x double").withColumn("ts", F.to_timestamp("t"))
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    config = EvalConfig((ModelSpec("0D", "x"),), (OVERALL, SlicingSpec(("g",))), (MetricConfig("ExampleCount"), MetricConfig("MeanPrediction")))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = running_metrics(stream, config, "ts", "1 minute", "10 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    got = {(r.window.start.minute, len(r.slice_key)): (r.ExampleCount, r.MeanPrediction) for r in spark.table("windows").collect()}
    assert got == {(0, 0): (2, 2.0), (0, 1): (2, 2.0), (1, 0): (1, 5.0), (1, 1): (1, 5.0)}
    assert {r.ExampleCount for r in running_metrics(frame, config).collect()} == {3, 2, 1}


def test_no_rows(frame):
    config = EvalConfig((ModelSpec("label", "prediction", "weight"),), (OVERALL, SlicingSpec(("gender",))), binary_metrics())
    assert evaluate(frame.limit(0), config)["metrics"].collect() == []


def test_curves_and_sub_keys_by_configuration(spark):
    from metricloom.plans.evaluate import binarized, wide

    rows = [(1.0, 0.9), (0.0, 0.8), (1.0, 0.7), (0.0, 0.1)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    config = EvalConfig(metrics=(MetricConfig("AUC"), MetricConfig("AUCPrecisionRecall"), MetricConfig("SensitivityAtSpecificity", {"bound": 0.9}), MetricConfig("ExampleCount")))
    got = {r.metric: r.value for r in evaluate(df, config)["metrics"].collect()}
    assert got["AUC"] == pytest.approx(0.75) and got["SensitivityAtSpecificity@0.9"] == 0.5 and got["ExampleCount"] == 4 and 0.5 < got["AUCPrecisionRecall"] < 1
    with pytest.raises(ValueError, match="no metrics"):
        evaluate(df, EvalConfig())
    arrays = spark.createDataFrame([([0.0, 1.0, 0.0], [0.2, 0.5, 0.3]), ([1.0, 0.0, 0.0], [0.1, 0.2, 0.7])], "label array<double>, prediction array<double>")
    found = {r.sub_key: r for r in wide(binarized(arrays, (1,), (1, 2), (2,)), EvalConfig(metrics=(MetricConfig("TruePositives", {"threshold": 0.15}), MetricConfig("FalsePositives", {"threshold": 0.15}))), ["sub_key"]).collect()}
    assert {k: (r["TruePositives@0.15"], r["FalsePositives@0.15"]) for k, r in found.items()} == {"class:1": (1, 1), "k:1": (1, 1), "k:2": (0, 2), "top_k:2": (1, 3)}


def test_grouping_sets_give_the_same_sums(spark):
    rows = [(i % 3, i % 5, i % 2, None if i % 7 == 0 else i % 4, [i % 2, i % 3], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, tags array<int>, x double")
    specs = (OVERALL, SlicingSpec(("a",)), SlicingSpec(("b", "c")), SlicingSpec(("d",), {"a": 1}), SlicingSpec(("tags",)), SlicingSpec(("a",)))
    few = [slicing.grouped_sums(df, (s,), {"x": F.col("x"), "n": F.lit(1)}) for s in specs[:5]]
    wanted = sorted((str(r.slice_key), r.x, r.n) for f in few for r in f.collect())
    assert sorted((str(r.slice_key), r.x, r.n) for r in slicing.grouped_sums(df, specs, {"x": F.col("x"), "n": F.lit(1)}).collect()) == wanted
    by = slicing.grouped_sums(df, specs, {"n": F.lit(1)}, by=["c"])
    assert sum(r.n for r in by.collect() if not r.slice_key) == 60 and by.where("size(slice_key) = 2 and slice_key[1].key = 'c'").count() == 10


def test_configured_classes_rankings_and_texts(spark):
    rows = [([0.0, 1.0, 0.0], [0.2, 0.5, 0.3], "q", 2.0, "a b c d", ["a b c d"]), ([1.0, 0.0, 0.0], [0.1, 0.2, 0.7], "q", 1.0, "a b", ["x y"])]
    df = spark.createDataFrame(rows, "label array<double>, prediction array<double>, q string, gain double, text string, refs array<string>")
    at = {"threshold": 0.15}
    config = EvalConfig(metrics=(MetricConfig("Recall", at, (0, 1, 2)), MetricConfig("Recall", at, (0, 1, 2), average="macro", class_weights={0: 1, 1: 3}), MetricConfig("Precision", at, (0, 1), average="micro"), MetricConfig("Precision", at, top_ks=(2,))))
    assert EvalConfig.from_json(config.to_json()) == config
    got = {(r.metric, r.sub_key): r.value for r in evaluate(df, config)["metrics"].collect()}
    assert got["Recall@0.15", "class:0"] == 0 and got["Recall@0.15", "class:1"] == 1 and got["Recall@0.15", "macro"] == 0.75
    assert got["Precision@0.15", "micro"] == pytest.approx(1 / 3) and got["Precision@0.15", "top_k:2"] == 0.25
    with pytest.raises(ValueError):
        MetricConfig("Recall", average="macro")
    ranked = EvalConfig((ModelSpec("label[0]", "prediction[0]"),), metrics=(MetricConfig("NDCG", {"query": "q", "gain": "gain", "ks": [1]}), MetricConfig("QueryStatistics", {"query": "q"})))
    assert {r.metric: r.value for r in evaluate(df, ranked)["metrics"].collect()} == {"NDCG@1": 1.0, "total_queries": 1, "total_documents": 2, "min_documents": 2, "max_documents": 2}
    texts = EvalConfig((ModelSpec("refs", "text"),), metrics=(MetricConfig("BLEU"), MetricConfig("ROUGE", {"rouge_type": "rougeL"})))
    found = {r.metric: r.value for r in evaluate(df, texts)["metrics"].collect()}
    assert found["rougeL/recall"] == 0.5 and 0 < found["BLEU"] < 100


def test_missing_slices_and_curve_intervals(spark):
    df = spark.createDataFrame([(float(i % 2), (i * 37 % 100) / 100, "a", i) for i in range(200)], "label double, prediction double, g string, i int")
    config = EvalConfig(slices=(OVERALL, SlicingSpec(("g",))), metrics=(MetricConfig("AUC"), MetricConfig("MeanLabel")), options=Options(intervals="jackknife", identity=("i",)))
    got = evaluate(df, config)["metrics"]
    rows = {(r.slice, r.metric): r for r in got.collect()}
    assert set(rows) == {(s, m) for s in ("Overall", "g:a") for m in ("AUC", "MeanLabel")} and all(r.lower < r.value < r.upper for r in rows.values())
    assert [r.spec for r in validation.missing_slices(got, (OVERALL, SlicingSpec(("h",)), SlicingSpec(("g",), {}))).collect()] == [1]


def test_nan_and_null_predictions(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan), (1.0, 0.9), (0.0, nan), (0.0, 0.2), (1.0, None)], "label double, prediction double")
    names = ("TruePositives", "FalseNegatives", "TrueNegatives", "FalsePositives", "Recall", "ExampleCount")
    got = {r.metric: r.value for r in evaluate(df, EvalConfig(metrics=tuple(map(MetricConfig, names))))["metrics"].collect()}
    assert got == {"TruePositives": 1, "FalseNegatives": 1, "TrueNegatives": 2, "FalsePositives": 0, "Recall": 0.5, "ExampleCount": 5}
    cells = curves.matrices(curves.histogram(df.withColumn("weight", F.lit(1.0))), [0.5]).first()
    assert (cells.tp, cells.fn, cells.tn, cells.fp) == (1, 1, 2, 0)
    none = evaluate(df.where("prediction is null"), EvalConfig(metrics=(MetricConfig("MeanPrediction"),)))["metrics"].first()
    assert math.isnan(none.value)
    models = (ModelSpec("label", "label", None, "base", True), ModelSpec("label", "prediction", None, "new"))
    flips = {r.metric: r.value for r in evaluate(df, EvalConfig(models, metrics=(MetricConfig("PosToNegFlipRate"), MetricConfig("NegToNegFlipRate"))))["metrics"].where("model = 'new'").collect()}
    assert flips == {"PosToNegFlipRate": 0.2, "NegToNegFlipRate": 0.4}
