"""Metrics over queries, each a group of documents ordered by prediction; equal predictions keep a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import div
from metricloom.operators.confidence import Sampling
from metricloom.operators.slicing import SlicingSpec, slice_keys


def _ranked(df: DataFrame, query: str, prediction: str, order: Sequence[str]) -> DataFrame:
    q = F.coalesce(F.col(query).cast("string"), F.lit(""))  # rows without a query stand together
    by = Window.partitionBy("__q").orderBy(F.desc(prediction), *order)
    return df.withColumn("__q", q).withColumn("__rank", F.row_number().over(by))


def _queries(ranked: DataFrame, specs: Sequence[SlicingSpec], weight: str | None, sums: dict[str, Column]) -> DataFrame:
    """A row for each query: its slices (the union over its documents), its weight and the sums."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    # a query has one weight: an error where its documents differ
    one = F.when(F.max(w) == F.min(w), F.max(w)).otherwise(F.raise_error(F.lit("the documents of a query differ in weight")).cast("double"))
    drawn = [F.min("__drawn").alias("__drawn")] if "__drawn" in ranked.columns else []  # a query is in one sample as a whole
    return (
        ranked.withColumn("__s", slice_keys(ranked, specs))
        .groupBy("__q")
        .agg(F.array_distinct(F.flatten(F.collect_set("__s"))).alias("__s"), one.alias("__w"), F.count("*").cast("double").alias("__n"), *(c.alias(n) for n, c in sums.items()), *drawn)
    )


def _totals(queries: DataFrame, states: dict[str, Column], sampling: Sampling | None, kinds: dict[str, str] | None = None) -> tuple[DataFrame, list[str]]:
    """Sums over the queries of each slice, by sample if there is a sampling, and the columns that tell them apart."""

    def grouped(df: DataFrame, specs: object, states: dict[str, Column], by: Sequence[str], kinds: dict[str, str] | None) -> DataFrame:
        return df.withColumn("slice_key", F.explode("__s")).groupBy("slice_key", *by).agg(*(getattr(F, (kinds or {}).get(n, "sum"))(c).alias(n) for n, c in states.items()))

    sums = (sampling or Sampling()).sums(queries, (), states, (), kinds, grouped)
    return (sums, ["slice_key", "__b"]) if sampling else (sums.drop("__b"), ["slice_key"])


def ndcg(df: DataFrame, query: str, gain: str, ks: Sequence[int], prediction: str = "prediction", weight: str | None = None, specs: Sequence[SlicingSpec] = (), order: Sequence[str] = (), sampling: Sampling | None = None) -> DataFrame:
    """``slice_key, k, value``: discounted cumulative gain over the ideal one, averaged over queries with a gain above 0."""
    ranked = _ranked(df, query, prediction, order).withColumn("__ideal", F.row_number().over(Window.partitionBy("__q").orderBy(F.desc(gain))))
    discount = lambda rank, k: F.sum(F.when(F.col(rank) <= k, F.col(gain) / F.log2(F.col(rank) + 1)).otherwise(0.0))
    sums = {"__best": F.max(gain)} | {f"d{k}": discount("__rank", k) for k in ks} | {f"i{k}": discount("__ideal", k) for k in ks}
    queries = _queries(ranked, specs, weight, sums).withColumn("__w", F.when(F.col("__best") > 0, F.col("__w")).otherwise(0.0))
    gained = {f"v{k}": F.when(F.col(f"i{k}") > 0, F.col("__w") * F.col(f"d{k}") / F.col(f"i{k}")).otherwise(0.0) for k in ks}
    out, keys = _totals(queries, {"w": F.col("__w")} | gained, sampling)
    return out.select(*keys, F.inline(F.array(*(F.struct(F.lit(k).alias("k"), div(F.col(f"v{k}"), F.col("w")).alias("value")) for k in ks))))


def min_label_position(df: DataFrame, query: str, label: str = "label", prediction: str = "prediction", weight: str | None = None, specs: Sequence[SlicingSpec] = (), order: Sequence[str] = (), sampling: Sampling | None = None) -> DataFrame:
    """``slice_key, value``: the mean place, from 1, of the first positive document; queries without one don't count."""
    first = {"first": F.min(F.when(F.col(label) > 0, F.col("__rank")))}
    queries = _queries(_ranked(df, query, prediction, order), specs, weight, first).where("first is not null")
    out, keys = _totals(queries, {"w": F.col("__w"), "f": F.col("__w") * F.col("first")}, sampling)
    return out.select(*keys, div(F.col("f"), F.col("w")).alias("value"))


def query_statistics(df: DataFrame, query: str, weight: str | None = None, specs: Sequence[SlicingSpec] = (), sampling: Sampling | None = None) -> DataFrame:
    """``slice_key, total_queries, total_documents, min_documents, max_documents``, by weight."""
    queries = _queries(df.withColumn("__q", F.coalesce(F.col(query).cast("string"), F.lit(""))), specs, weight, {}).withColumn("__d", F.col("__w") * F.col("__n"))
    states = {"total_queries": F.col("__w")} | {f"{n}_documents": F.col("__d") for n in ("total", "min", "max")}
    out, keys = _totals(queries, states, sampling, {"min_documents": "min", "max_documents": "max"})
    return out.select(*keys, *states)


def group_by_query(df: DataFrame, query: str, columns: Sequence[str], specs: Sequence[SlicingSpec] = ()) -> DataFrame:
    """A row for each query with the lists of its rows' columns, and its slices; a group is as large as its query."""
    q = df.withColumn("__q", F.coalesce(F.col(query).cast("string"), F.lit(""))).withColumn("__s", slice_keys(df, specs))
    return q.groupBy(F.col("__q").alias("query")).agg(F.array_distinct(F.flatten(F.collect_set("__s"))).alias("slice_keys"), F.collect_list(F.struct(*columns)).alias("rows"))


