"""Queries give the same rows when executors come or go between the call and the action.

Spark sizes scan splits by the cores that are there when a plan is made; that is what changes here.
"""

import pytest

from metricloom.llm import queries, suffix_dedup
from metricloom.llm.common import table

SETTING = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture(scope="module")
def several_files(spark, sf_dir, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("several"))
    for name, files in (("documents", 7), ("benchmark", 1), ("labels", 2)):
        df = table(spark, sf_dir, name)
        (df.repartition(files) if files > 1 else df).write.parquet(f"{to}/{name}.parquet")
    return to


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "op2_packing"])  # its pools are those of the scan
def test_rows_do_not_depend_on_splits(spark, several_files, name):
    def plain(x):  # sums of floats come in another order on other batches
        return round(x, 9) if isinstance(x, float) else [plain(y) for y in x] if isinstance(x, list | tuple) else x

    def rows(before, after):
        spark.conf.set(SETTING, before)
        try:
            df = queries.QUERIES[name](spark, several_files)
            spark.conf.set(SETTING, after)
            return sorted(str(plain(r)) for r in df.collect())
        finally:
            spark.conf.unset(SETTING)

    assert rows(2, 2) == rows(2, 9)


def test_repeats_on_other_splits_against_all_windows(spark, several_files):
    spark.conf.set(SETTING, 2)
    try:
        found = suffix_dedup.dedup(table(spark, several_files, "documents"))
        spark.conf.set(SETTING, 9)
        got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans]) for r in found.collect()}
    finally:
        spark.conf.unset(SETTING)
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, several_files, "documents").collect()}
    seen = {}
    for data in texts.values():
        for i in range(len(data) - 399):
            w = data[i : i + 400]
            seen[w] = seen.get(w, 0) + 1
    for k, data in texts.items():
        ranges = suffix_dedup.merge([[i, i + 400] for i in range(len(data) - 399) if seen[data[i : i + 400]] > 1])
        assert got[k] == (len(data), [tuple(r) for r in ranges])
