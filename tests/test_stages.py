from datetime import date

import pytest

from millrace import AggSpec, HasType, NoNulls, OneOf, Pipeline, Range, RowsAtLeast, RowsAtMost, Unique
from millrace.errors import ConfigError, DataQualityError, MillraceError, SchemaError


@pytest.fixture
def scores(spark):
    return spark.createDataFrame([("eng", 10), ("ops", None), ("eng", 30), ("hr", 5), (None, 1)], "dept string, score int")


def rows(p):
    return [tuple(r.values()) for r in p.collect()]


def test_aggregates(spark, scores):
    p = Pipeline(spark).from_df(scores).aggregate(["dept"], [AggSpec(f, "score") for f in ("sum", "avg", "count", "min", "max")] + [AggSpec("count_all")]).sort(["dept"])
    assert rows(p) == [(None, 1, 1.0, 1, 1, 1, 1), ("eng", 40, 20.0, 2, 10, 30, 2), ("hr", 5, 5.0, 1, 5, 5, 1), ("ops", None, None, 0, None, None, 1)]
    assert dict(p.to_df().dtypes) == {"dept": "string", "sum_score": "bigint", "avg_score": "double", "count_score": "bigint", "min_score": "int", "max_score": "int", "count_all": "bigint"}


def test_aggregate_names_and_errors(spark, scores):
    p = lambda: Pipeline(spark).from_df(scores)
    assert p().group_by(["dept"]).agg({"score": "max", "n": "count_all"}).to_df().columns == ["dept", "max_score", "n"]
    for spec in (AggSpec("sum", "dept"), AggSpec("avg", "dept"), AggSpec("sum", "nope")):
        with pytest.raises(SchemaError):
            p().aggregate([], [spec]).to_df()
    with pytest.raises(ConfigError, match="unknown function"):
        p().aggregate([], [AggSpec("median", "score")]).to_df()
    with pytest.raises(SchemaError):
        Pipeline(spark).from_df(scores.selectExpr("score > 1 AS flag")).aggregate([], [AggSpec("min", "flag")]).to_df()
    with pytest.raises(ConfigError):
        p().group_by(["dept"]).filter("true")


def test_dates_and_empty_global(spark):
    df = spark.createDataFrame([(date(2024, 3, 1),), (date(2024, 1, 1),), (date(2024, 2, 1),)], "d date")
    assert rows(Pipeline(spark).from_df(df).aggregate([], [AggSpec("min", "d"), AggSpec("max", "d")])) == [("2024-01-01", "2024-03-01")]
    assert rows(Pipeline(spark).from_df(df.limit(0)).aggregate([], [AggSpec("count_all")])) == [(0,)]


def test_sort_nulls_and_top(spark, scores):
    p = lambda: Pipeline(spark).from_df(scores.coalesce(1))
    assert [r[1] for r in rows(p().sort(["score"]))] == [None, 1, 5, 10, 30]
    assert [r[1] for r in rows(p().sort(["score"], descending=True))] == [30, 10, 5, 1, None]
    assert rows(p().sort(["dept", "score"], descending=[False, True]).limit(2)) == [(None, 1), ("eng", 30)]
    plan = p().sort(["score"]).limit(2).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    with pytest.raises(SchemaError):
        p().sort(["nope"]).to_df()


def test_first_rows_in_file_order(spark, tmp_path):
    spark.range(0, 1000, 1, 8).selectExpr("id", "id % 7 AS k", "-id AS v").write.parquet(str(tmp_path / "t"))
    p = lambda: Pipeline(spark).read_parquet(str(tmp_path / "t"))
    assert [r[0] for r in rows(p().limit(5).sort(["id"]))] == [0, 1, 2, 3, 4]
    assert rows(p().dedup(["k"]).sort(["k"])) == [(k, k, -k) for k in range(7)]
    assert rows(p().sort(["v"]).dedup(["k"]).select(["k", "id"]).sort(["k"])) == [(k, 999 - (999 - k) % 7) for k in range(7)]
    assert rows(p().sort(["v"]).filter("k == 0").map({"id": "id"}).limit(1)) == [(994,)]


def test_dedup_rows(spark):
    df = spark.createDataFrame([("a", "sb"), ("as", "b"), ("a", "sb"), (None, None), (None, None)], "x string, y string")
    assert len(rows(Pipeline(spark).from_df(df).dedup())) == 3
    assert len(rows(Pipeline(spark).from_df(df).dedup(["x", "y"]))) == 3
    with pytest.raises(SchemaError):
        Pipeline(spark).from_df(df).dedup(["z"]).to_df()


@pytest.mark.parametrize(
    "how, want",
    [
        ("inner", [(1, 10, 1, "a"), (1, 10, 1, "b"), (1, 11, 1, "a"), (1, 11, 1, "b")]),
        ("left", [(None, 5, None, None), (1, 10, 1, "a"), (1, 10, 1, "b"), (1, 11, 1, "a"), (1, 11, 1, "b"), (2, 20, None, None)]),
        ("right", [(None, None, 3, "c"), (None, None, None, "n"), (1, 10, 1, "a"), (1, 10, 1, "b"), (1, 11, 1, "a"), (1, 11, 1, "b")]),
        ("full", [(None, None, 3, "c"), (None, None, None, "n"), (None, 5, None, None), (1, 10, 1, "a"), (1, 10, 1, "b"), (1, 11, 1, "a"), (1, 11, 1, "b"), (2, 20, None, None)]),
    ],
)
def test_joins(spark, how, want):
    left = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 5)], "id int, score int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "n")], "id int, name string")
    p = Pipeline(spark).from_df(left).join(right, ["id"], ["id"], how)
    assert p.to_df().columns == ["id", "score", "id_r", "name"]
    assert sorted(rows(p), key=repr) == sorted(want, key=repr)


def test_join_errors_and_empty(spark):
    left, right = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([], "id int, id_r int")
    with pytest.raises(SchemaError, match="twice"):
        Pipeline(spark).from_df(left).join(right, ["id"], ["id"]).to_df()
    with pytest.raises(ConfigError):
        Pipeline(spark).from_df(left).join(right.select("id"), ["id"], ["id"], "cross").to_df()
    with pytest.raises(SchemaError, match="right"):
        Pipeline(spark).from_df(left).join(right, ["id"], ["nope"]).to_df()
    assert rows(Pipeline(spark).from_df(left).join(right.select("id"), ["id"], ["id"])) == []
    with pytest.raises(DataQualityError):
        Pipeline(spark).from_df(left).join(spark.createDataFrame([(None,)], "id int"), ["id"], ["id"], strict_nulls=True).to_df()


def test_join_keeps_left_order(spark, tmp_path):
    spark.range(0, 100, 1, 4).write.parquet(str(tmp_path / "l"))
    right = spark.range(100).selectExpr("id AS rid", "id * 2 AS twice")
    p = Pipeline(spark).read_parquet(str(tmp_path / "l")).join(right, ["id"], ["rid"]).limit(3).sort(["id"])
    assert rows(p) == [(0, 0, 0), (1, 1, 2), (2, 2, 4)]


def test_sample_vector(spark):
    ids = spark.range(8)
    assert [r[0] for r in rows(Pipeline(spark).from_df(ids).sample(0.5, "id", 0).sort(["id"]))] == [0, 4, 5, 6, 7]
    many = spark.range(20_000).selectExpr("id", "cast(id AS string) AS s", "id % 3 = 0 AS b")
    n = len(rows(Pipeline(spark).from_df(many).sample(0.25, ["s", "b"], 7)))
    assert abs(n / 20_000 - 0.25) < 0.02
    assert rows(Pipeline(spark).from_df(ids).sample(0, "id")) == [] and len(rows(Pipeline(spark).from_df(ids).sample(1, "id"))) == 8
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(ConfigError):
            Pipeline(spark).from_df(ids).sample(bad, "id")


@pytest.mark.parametrize(
    "good, bad",
    [
        (RowsAtLeast(4), RowsAtLeast(5)),
        (RowsAtMost(4), RowsAtMost(3)),
        (NoNulls("id"), NoNulls("s")),
        (Unique("id"), Unique("k")),
        (Range("id", 1, 4), Range("id", 2, None)),
        (Range("k", None, 9), Range("f", 0, None)),
        (OneOf("s", ("a", "b")), OneOf("s", ("a",))),
        (OneOf("k", (1, 2)), OneOf("k", ("1", "2"))),
        (HasType("id", "int32"), HasType("id", "int64")),
    ],
)
def test_checks(spark, good, bad):
    df = spark.createDataFrame([(1, "a", 1, 1.0), (2, "b", 1, 0.0), (3, None, 2, float("nan")), (4, "a", None, None)], "id int, s string, k int, f double")
    assert len(rows(Pipeline(spark).from_df(df).expect(good))) == 4
    with pytest.raises(DataQualityError):
        Pipeline(spark).from_df(df).expect(good, bad).collect()
    with pytest.raises(DataQualityError, match="available"):
        Pipeline(spark).from_df(df).expect(NoNulls("nope")).collect()


def test_checks_stop_before_the_sink(spark, tmp_path):
    out = tmp_path / "o.csv"
    with pytest.raises(DataQualityError):
        Pipeline(spark).from_df(spark.range(3)).expect(rows_at_least=9).write_csv(str(out)).execute()
    assert not out.exists()


def test_closures_and_dead_letters(spark, tmp_path):
    dead, out = tmp_path / "dead.csv", tmp_path / "o.csv"
    p = Pipeline(spark).from_df(spark.range(5).coalesce(1)).map_fn({"x": "float64"}, lambda r: [10 / (r["id"] - 2)]).dead_letter(str(dead)).write_csv(str(out))
    p.execute()
    assert p.dead_letter_rows() == 1 and dead.read_text().splitlines() == ["_dead_letter_stage,_error,id", "map,ZeroDivisionError: division by zero,2"]
    assert out.read_text().splitlines() == ["x", "-5", "-10", "10", "5"]
    clean = Pipeline(spark).from_df(spark.range(2)).filter_fn(lambda r: True).dead_letter(str(dead))
    clean.execute()
    assert dead.read_bytes() == b"" and clean.dead_letter_rows() == 0
    with pytest.raises(Exception, match="ZeroDivision"):
        Pipeline(spark).from_df(spark.range(5)).filter_fn(lambda r: 1 / r["id"] > 0).collect()


def test_surface(spark):
    p = Pipeline(spark).from_df(spark.range(9)).filter("id > 2").sort(["id"]).limit(2)
    assert p.explain() == "source -> filter -> Sort -> limit -> sink" and p.num_stages() == 3 and "filter" in repr(p)
    assert p.preview(1) == [{"id": 3}]
    seen = []
    stats = p.on_progress(seen.append).execute()
    assert stats["rows"] == 9 and [s.rows_out for s in p.stage_stats()] == [6, 6, 2]
    assert [e.kind for e in seen] == ["source_batch", "stage_batch", "stage_batch", "stage_batch", "sink_batch", "done"]
    with pytest.raises(ConfigError):
        Pipeline(spark).collect()
    with pytest.raises(SchemaError):
        Pipeline(spark).from_df(spark.range(1)).select(["nope"]).to_df()
    with pytest.raises(MillraceError):
        Pipeline(spark).from_df(spark.sql("SELECT 1 AS a, 2 AS a")).collect()


def test_failing_progress_is_not_fatal(spark):
    Pipeline(spark).from_df(spark.range(1)).on_progress(lambda e: 1 / 0).execute()


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "id AS a", "id AS b").write.parquet(str(tmp_path / "t"))
    df = Pipeline(spark).read_parquet(str(tmp_path / "t")).filter("id > 90").select(["a"]).to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and "ReadSchema: struct<id:bigint,a:bigint>" in plan
    spark.range(100).selectExpr("id", "cast(id AS double) AS f").write.parquet(str(tmp_path / "u"))
    df = Pipeline(spark).read_parquet(str(tmp_path / "u")).filter("f > 45 and f <= 90.5").to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(f,45.0)" in plan and "LessThanOrEqual(f,90.5)" in plan and df.count() == 45
