"""Evaluation inputs and results in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.plans.config import EvalConfig

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_examples(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Examples from files; text-like forms need a schema, so no pass over the data guesses it."""
    if form not in FORMATS:
        raise ValueError(f"unknown form {form}")
    if form in ("csv", "json") and schema is None:
        raise ValueError(f"{form} needs a schema")
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_results(results: dict[str, DataFrame], config: EvalConfig, path: str, form: str = "parquet") -> None:
    """Each table of results in a folder of its own, and the configuration beside them as one line of JSON."""
    if not results:
        raise ValueError("there are no results")
    for name, frame in results.items():
        frame.write.format(form).mode("errorifexists").save(f"{path}/{name}")
    spark = next(iter(results.values())).sparkSession
    spark.createDataFrame([(config.to_json(),)], "config string").coalesce(1).write.mode("errorifexists").json(f"{path}/config")


def read_results(spark: SparkSession, path: str, names: tuple[str, ...] = ("metrics",), form: str = "parquet") -> tuple[EvalConfig, dict[str, DataFrame]]:
    config = EvalConfig.from_json(spark.read.schema("config string").json(f"{path}/config").first().config)
    return config, {n: spark.read.format(form).load(f"{path}/{n}") for n in names}


def read_runs(spark: SparkSession, paths: dict[str, str], name: str = "metrics", form: str = "parquet") -> DataFrame:
    """One table of several runs, with the run's name: a series over time."""
    out = None
    for run, path in paths.items():
        one = spark.read.format(form).load(f"{path}/{name}").withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("there are no runs")
    return out
