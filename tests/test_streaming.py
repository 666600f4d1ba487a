import pytest

from millrace import AggSpec, Pipeline
from millrace.errors import UnsupportedStreaming
from millrace.streaming.runs import for_each_batch, read_stream, run_available, stream_flow


@pytest.fixture
def folder(spark, tmp_path):
    spark.range(0, 100, 1, 4).selectExpr("id", "id % 5 AS k").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_available_now_is_the_batch(spark, folder):
    schema = spark.read.parquet(folder).schema
    make = lambda df: Pipeline(spark).from_df(df).filter("id % 2 == 0").aggregate(["k"], [AggSpec("sum", "id"), AggSpec("count_all")])
    want = sorted(map(tuple, make(spark.read.parquet(folder)).to_df().collect()))
    assert sorted(map(tuple, run_available(spark, schema, folder, make, ["k"]).collect())) == want
    rows = run_available(spark, schema, folder, lambda df: Pipeline(spark).from_df(df).map({"x": "id * 2"}).dedup(["x"]))
    assert sorted(r.x for r in rows.collect()) == list(range(0, 200, 2))


def test_static_join_and_sample(spark, folder):
    names = spark.createDataFrame([(1, "one"), (2, "two")], "n long, name string")
    schema = spark.read.parquet(folder).schema
    got = run_available(spark, schema, folder, lambda df: Pipeline(spark).from_df(df).sample(0.5, "id").join(names, ["k"], ["n"]))
    want = Pipeline(spark).from_df(spark.read.parquet(folder)).sample(0.5, "id").join(names, ["k"], ["n"]).to_df()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_refused(spark, folder):
    stream = read_stream(spark, folder, spark.read.parquet(folder).schema)
    static = spark.range(3)
    for p in (Pipeline(spark).sort(["id"]), Pipeline(spark).expect(rows_at_least=1), Pipeline(spark).join(static.toDF("x"), ["id"], ["x"], "full")):
        with pytest.raises(UnsupportedStreaming):
            stream_flow(p, stream)
    with pytest.raises(UnsupportedStreaming):
        stream_flow(Pipeline(spark), static)


def test_each_batch(spark, folder, tmp_path):
    stream = read_stream(spark, folder, spark.read.parquet(folder).schema)
    out = str(tmp_path / "o.parquet")
    for_each_batch(lambda b: Pipeline(spark).from_df(b).sort(["id"], descending=True).limit(3).write_parquet(out), stream, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [97, 98, 99]
