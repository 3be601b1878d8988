"""The mix against one loop over a sorted list, and what it promises of sources and documents."""

import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from metricloom.llm import mixing
from metricloom.llm.queries import op13_mixing

SCHEMA = "doc_id long, text string, source string, before long, row int, place string, words string, copy int"


def levels(sizes, budget, weights=(1, 2, 3), times=3):
    """Targets by sharing again what is above, with fractions."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    most = {s: times * n for s, n in sizes.items()}
    full = set()
    while True:
        free, w = budget - sum(most[s] for s in full), sum(weight[s] for s in sizes if s not in full)
        out = {s: Fraction(most[s]) if s in full else Fraction(weight[s] * free, w) for s in sizes}
        above = {s for s in sizes if s not in full and out[s] >= most[s]}
        if not above:
            return out
        full |= above


def brute(rows, budget=None, weights=(1, 2, 3), times=3):
    docs = []
    for k, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        place = int(hashlib.md5(f"mix:{'' if k is None else k}".encode()).hexdigest()[:15], 16)
        docs.append((s is None, s or "", place, k is None, k or 0, hashlib.md5((t or "").encode()).hexdigest(), n, k, s))
    docs.sort(key=lambda d: d[:6])
    sizes = {}
    for d in docs:
        sizes[d[8]] = sizes.get(d[8], 0) + d[6]
    total = sum(sizes.values())
    budget = total if budget is None else min(budget, times * total)
    target = {s: float(x) for s, x in levels(sizes, budget, weights, times).items()}
    units, at = [], {}
    for i, d in enumerate(docs):
        n, s = d[6], d[8]
        before = at.get(s, 0)
        at[s] = before + n
        for copy in range(times if n else 0):
            start = before + copy * sizes[s]
            if start >= target[s]:
                continue
            whole = start + n <= target[s]
            for first in [0] if whole else range(0, n, 64):
                if whole or start + first < target[s]:
                    words = n if whole else min(64, n - first)
                    units.append(((start + first + words) / target[s], *d[:6], copy, first, words, i))
    taken, left = [0] * len(docs), budget
    for u in sorted(units):
        taken[u[-1]] += min(u[-2], left)
        left -= min(u[-2], left)
    return sorted(((d[7], d[6], sizes[d[8]], round(target[d[8]], 6), taken[i]) for i, d in enumerate(docs)), key=str)


def results(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p", "w", 3) for r in rows], SCHEMA)


ODD = [
    (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "long " * 5000, "y"), (5, "d e", None), (6, "f", None), (None, "g h i j", "z"), (8, "k" * 9000, "é"), (9, "m n " * 40, "zz"), (10, " \t\x0b\n", "only blanks"),
    (11, "o p q " * 100, "z"), (12, "r s t", "x"), (13, "u " * 900, "w"), (14, "v " * 900, "w"), (-1, "x y", "w"),
]


def test_query_against_a_loop(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert results(op13_mixing(spark, sf_dir)) == brute(rows)


def test_sources_come_near_their_targets(spark, sf_dir):
    df = op13_mixing(spark, sf_dir)
    assert df.where("taken > 3 * size").count() == 0
    by = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").join(df, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size")).collect()
    assert sum(r.taken for r in by) == sum(r["size"] for r in by)
    assert all(abs(r.taken - r.target) <= 2 * mixing.RUN for r in by)


def test_odd_rows(spark):
    assert results(mixing.mix(frame(spark, ODD).repartition(5))) == brute(ODD)
    assert results(mixing.mix(frame(spark, ODD), weights=(5, 1), times=2, budget=3000)) == brute(ODD, 3000, (5, 1), 2)
    assert results(mixing.mix(frame(spark, ODD), budget=10**9)) == brute(ODD, 10**9)
    assert results(mixing.mix(frame(spark, ODD[1:3]))) == [(2, 0, 0, 0.0, 0), (3, 0, 0, 0.0, 0)]
    assert mixing.mix(frame(spark, [])).collect() == []
    twice = sorted(r.taken for r in mixing.mix(frame(spark, [(1, "a b", "s"), (1, "a b", "s"), (1, "c", "s")])).collect())
    assert sum(twice) == 5


def test_reruns_agree_on_other_partitions(spark):
    df = frame(spark, [(i, "w " * (i % 37), f"s{i % 5}" if i % 3 else "hot") for i in range(400)])
    assert results(mixing.mix(df.repartition(1))) == results(mixing.mix(df.repartition(7, "text")))


@pytest.mark.parametrize("group", [None, "source"])
def test_running_sums_over_many_ranges(spark, group):
    df = frame(spark, [(i, "t", "hot" if i % 3 else None if i % 2 else f"s{i}") for i in range(200)]).withColumn("n", F.col("doc_id") * 3)
    order = [F.col("source").asc_nulls_last(), F.desc("doc_id")]
    got = {r.doc_id: r.before for r in mixing.running(df.drop("before"), order, "n", group).collect()}
    rows = sorted(df.collect(), key=lambda r: (r.source is None, r.source or "", -r.doc_id))
    for i, r in enumerate(rows):
        assert got[r.doc_id] == sum(x.n for x in rows[:i] if group is None or x.source == r.source)


def test_parameters(spark):
    for wrong in ({"weights": ()}, {"weights": (0,)}, {"budget": -1}):
        with pytest.raises(ValueError):
            mixing.mix(frame(spark, ODD), **wrong)
