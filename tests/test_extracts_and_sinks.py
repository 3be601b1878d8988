"""Parts of rows by paths, with the columns that a scan reads; record files that are written; counts of a running plan."""

import datetime
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from metricloom.functions import extracts
from metricloom.operators.slicing import OVERALL, SlicingSpec
from metricloom.plans.config import EvalConfig, MetricConfig, ModelSpec
from metricloom.plans.counters import counted, row_bytes
from metricloom.sources.records import RecordWriter, checksum, frames, read_records, write_records

NESTED = "id int, a struct<b: struct<c: int, d: string>, e: int>, m map<string, struct<x: int, y: int>>, l array<struct<p: int, q: string>>, k map<int, int>"
ROWS = [(1, ((3, "z"), 4), {"u": (1, 2), "v": (5, 6)}, [(7, "q"), (8, "r")], {1: 2}), (2, None, None, None, None), (3, (None, 5), {}, [], {})]


@pytest.fixture(scope="module")
def nested(spark):
    return spark.createDataFrame(ROWS, NESTED)


def plain(frame):
    return [r.asDict(recursive=True) for r in frame.orderBy("id").collect()]


def test_include_and_exclude(nested):
    kept = plain(extracts.include(nested, ["id", "a.b.c", "m.u.x", "l.p"]))
    assert kept[0] == {"id": 1, "a": {"b": {"c": 3}}, "m": {"u": {"x": 1}}, "l": [{"p": 7}, {"p": 8}]}
    assert kept[1] == {"id": 2, "a": None, "m": None, "l": None} and kept[2] == {"id": 3, "a": {"b": None}, "m": {}, "l": []}
    left = plain(extracts.exclude(nested, ["a.b.c", "m.u", "l.p", "k"]))
    assert left[0] == {"id": 1, "a": {"b": {"d": "z"}, "e": 4}, "m": {"v": {"x": 5, "y": 6}}, "l": [{"q": "q"}, {"q": "r"}]} and left[1]["a"] is None
    assert plain(extracts.exclude(nested, {"m": {"v": {"x": {}}}}))[0]["m"] == {"u": {"x": 1, "y": 2}, "v": {"x": None, "y": 6}}
    assert plain(extracts.include(nested, ["id", "m.u.x", "m.v.y"]))[0]["m"] == {"u": {"x": 1, "y": 2}, "v": {"x": 5, "y": 6}}
    for bad in (["none"], ["a.none"], ["id.x"]):
        with pytest.raises(ValueError):
            extracts.include(nested, bad)
        with pytest.raises(ValueError):
            extracts.exclude(nested, bad)
    with pytest.raises(ValueError, match="nothing is left"):
        extracts.exclude(nested, ["a.b.c", "a.b.d"])


def test_get_and_put(nested):
    got = nested.select("id", *(extracts.get(nested, p).alias(p.replace(".", "_")) for p in ("a.b.d", "m.v.y", "l.q", "k.1")))
    assert plain(got)[0] == {"id": 1, "a_b_d": "z", "m_v_y": 6, "l_q": ["q", "r"], "k_1": 2} and plain(got)[1] == {"id": 2, "a_b_d": None, "m_v_y": None, "l_q": None, "k_1": None}
    put = extracts.put(extracts.put(extracts.put(nested, "a.b.c", F.lit(9)), "k.5", F.lit(6)), "new.deep", F.col("id"))
    rows = plain(put)
    assert rows[0]["a"] == {"b": {"c": 9, "d": "z"}, "e": 4} and rows[0]["k"] == {1: 2, 5: 6} and rows[1]["k"] == {5: 6} and rows[2]["new"] == {"deep": 3}
    for path in ("id.x", "k.1.x", "l.p"):
        with pytest.raises(ValueError):
            extracts.put(nested, path, F.lit(1))


def test_trees():
    assert extracts.tree(["a.b.c", "a.b", "d"]) == {"a": {"b": {}}, "d": {}} and extracts.tree(["a", "a.b"]) == {"a": {}}
    assert extracts.merged(["a.b"], ["a.c", "d"], {"a": {"b": {"x": {}}}}) == {"a": {"b": {}, "c": {}}, "d": {}} and extracts.merged(["a.b"], ["a"]) == {"a": {}}


def test_a_scan_reads_only_what_is_kept(spark, nested, tmp_path):
    nested.write.parquet(str(tmp_path / "n"))
    df = spark.read.parquet(str(tmp_path / "n"))

    def read(frame):
        return frame._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]

    assert read(extracts.include(df, ["a.b.c", "l.p"])) == "struct<a:struct<b:struct<c:int>>,l:array<struct<p:int>>>"
    assert read(df.select(extracts.get(df, "a.b.d"))) == "struct<a:struct<b:struct<d:string>>>"
    assert read(extracts.exclude(df, ["a.b", "l.p", "m", "k"])) == "struct<id:int,a:struct<e:int>,l:array<struct<q:string>>>"


def test_records_are_written_and_read(spark, tmp_path):
    rows = [Row(id=1, name="é", x=0.5, ok=True, many=[1, 2], key=[Row(key="a", value="b")], at=datetime.datetime(2024, 1, 2)), Row(id=-2, name=None, x=None, ok=False, many=[], key=[], at=None)]
    df = spark.createDataFrame(rows, "id int, name string, x float, ok boolean, many array<long>, key array<struct<key: string, value: string>>, at timestamp_ntz")
    path = str(tmp_path / "r")
    write_records(df.repartition(2), path)
    schema = "id long, name string, x double, ok long, many array<long>, key string, at string"
    got = sorted(map(tuple, read_records(spark, path, schema).collect()))
    assert got == [(-2, None, None, 0, [], "[]", None), (1, "é", 0.5, 1, [1, 2], '[{"key":"a","value":"b"}]', "2024-01-02 00:00:00")]
    write_records(df, path)
    assert read_records(spark, path, schema).count() == 4
    write_records(df.limit(1), path, overwrite=True)
    assert read_records(spark, path, schema).count() == 1 and sorted(os.listdir(path))[0].startswith("part-")
    write_records(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(Exception, match="no longer"):
        write_records(df.withColumn("x", F.when(F.col("id") < 0, F.raise_error(F.lit("no longer"))).otherwise(F.col("x"))), path)
    assert read_records(spark, path, schema).count() == 1 and not os.path.exists(f"{path}/_temporary")


def test_a_lost_task_leaves_nothing(tmp_path):
    writer = RecordWriter(str(tmp_path / "w"), False)
    lost, kept = writer.write(iter([Row(a=1), Row(a=2)])), writer.write(iter([Row(a=1), Row(a=2)]))
    assert lost.file != kept.file and not [f for f in os.listdir(tmp_path / "w") if f.startswith("part")]
    writer.commit([kept, writer.write(iter([]))])
    assert os.listdir(tmp_path / "w") == [kept.file] and len(list(frames((tmp_path / "w" / kept.file).read_bytes()))) == 2
    again = RecordWriter(str(tmp_path / "w"), True)
    again.write(iter([Row(a=3)]))
    again.abort([])
    assert os.listdir(tmp_path / "w") == [kept.file]


def test_checksums():
    # CRC-32C of the digits 1 to 9 is E3069283
    assert checksum(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_counts_of_a_running_plan(spark):
    df = spark.createDataFrame([(1, "é", 0.5, [1, 2]), (2, None, 0.25, None), (3, "abc", 1.0, [])], "i int, g string, prediction double, l array<long>").withColumn("label", F.lit(1.0))
    assert df.select(row_bytes(df).alias("b")).agg(F.sum("b")).first()[0] == (3 * 4) + (2 + 3) + 3 * 8 + 16 + 3 * 8
    results, counters = counted(df, EvalConfig((ModelSpec("label", "prediction"),), (OVERALL, SlicingSpec(("g",))), (MetricConfig("MeanLabel"), MetricConfig("Specificity"))))
    results["metrics"].collect()
    assert counters.get() == {"rows": 3, "bytes": 81, "slices": 3, "values": 6, "undefined": 3}
    with pytest.raises(ValueError):
        counted(df, EvalConfig((ModelSpec("label", "prediction"),), metrics=(MetricConfig("AUC"),)))
