import json
import urllib.request

import pytest

from millrace import Pipeline, cli, sql, tools
from millrace.errors import ConfigError, ExpressionError, MillraceError, SchemaError
from millrace.plans import spec as specs
from millrace.plans.diff import diff
from millrace.streaming.telemetry import Event, Metrics

SALES = "region,amount,product\nwest,10,a\neast,0,b\nwest,5,it's\nnorth,7,\neast,20,b\n"


@pytest.fixture
def sales(tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(SALES)
    return str(path)


def run(spark, text, path):
    return [tuple(r) for r in sql(text.format(path), spark).collect()]


def test_sql(spark, sales):
    q = lambda t: run(spark, t, sales)
    assert q("SELECT region, SUM(amount) FROM '{}' WHERE amount > 0 GROUP BY region ORDER BY sum_amount DESC, region") == [("east", 20), ("west", 15), ("north", 7)]
    assert q("select distinct region from '{}' order by region limit 2") == [("east",), ("north",)]
    assert q("SELECT amount * 2 AS twice, region FROM '{}' WHERE product IS NULL") == [(14, "north")]
    assert q("SELECT region FROM '{}' WHERE product IS NOT NULL AND product = 'it''s'") == [("west",)]
    assert q("SELECT *, amount + 1 AS more FROM '{}' WHERE NOT amount > 5 ORDER BY amount") == [("east", 0, "b", 1), ("west", 5, "it's", 6)]
    assert q("SELECT COUNT(*) AS n, region AS r FROM '{}' GROUP BY region ORDER BY n DESC, r LIMIT 1") == [(2, "east")]
    assert q("SELECT region AS r FROM '{}' GROUP BY region ORDER BY r DESC LIMIT 1") == [("west",)]
    assert q("SELECT +amount AS a FROM '{}' WHERE (amount > 5) IS NOT TRUE ORDER BY a") == [(0,), (5,)]
    assert q("SELECT MIN(product) FROM '{}'") == [("a",)]
    assert sql("SELECT id FROM t WHERE id % 2 = 1", spark, {"t": spark.range(4)}).count() == 2


@pytest.mark.parametrize(
    "text",
    [
        "DELETE FROM t",
        "WITH x AS (SELECT 1) SELECT * FROM x",
        "SELECT * FROM a JOIN b ON a.x = b.x",
        "SELECT * FROM a UNION SELECT * FROM b",
        "SELECT * FROM a WHERE x BETWEEN 1 AND 2",
        "SELECT * FROM a WHERE x IN (1)",
        "SELECT * FROM a WHERE x LIKE 'y'",
        "SELECT upper(x) AS y FROM a",
        "SELECT x FROM a HAVING x > 1",
        "SELECT x FROM a LIMIT 1 OFFSET 2",
        "SELECT x + 1 FROM a",
        "SELECT SUM(x + 1) AS y FROM a",
        "SELECT SUM(*) FROM a",
        "SELECT x FROM a LIMIT 1.5",
        "SELECT x FROM a WHERE",
        "SELECT",
        "SELECT x FROM a extra",
    ],
)
def test_sql_rejects(spark, text):
    with pytest.raises(MillraceError):
        sql(text, spark, {"a": spark.range(1).selectExpr("id AS x")})


def test_sql_schema_errors(spark):
    t = {"a": spark.range(1).selectExpr("id AS x", "id AS y")}
    for text in ("SELECT x, SUM(y) FROM a", "SELECT *, COUNT(*) AS n FROM a", "SELECT z FROM a", "SELECT x FROM a ORDER BY y", "SELECT x FROM a WHERE z = 1"):
        with pytest.raises(SchemaError):
            sql(text, spark, t).collect()


SPEC = """
[source.csv]
path = "{0}"

[[stages]]
filter = "amount > 0"

[[stages]]
expect = {{ rows_at_least = 1, no_nulls = ["region"], ranges = {{ amount = {{ min = 0 }} }}, types = {{ amount = "int32" }} }}

[[stages]]
aggregate = {{ group_by = ["region"], aggs = {{ amount = "sum", "*" = "count_all" }} }}

[[stages]]
sort = {{ columns = ["sum_amount"], descending = true }}

[[stages]]
limit = 2

[sink.csv]
path = "${{OUT}}"
"""


def test_spec_runs(spark, sales, tmp_path, monkeypatch, capsys):
    out, spec = tmp_path / "out.csv", tmp_path / "p.toml"
    spec.write_text(SPEC.format(sales))
    monkeypatch.setenv("OUT", str(out))
    assert cli.main(["run", str(spec), "--manifest", str(tmp_path / "m.json")]) == 0
    assert out.read_text() == "region,count_all,sum_amount\neast,1,20\nwest,2,15\n"
    m = json.loads((tmp_path / "m.json").read_text())
    assert m["status"] == "ok" and m["stats"]["rows"] == 5 and m["inputs"][0]["bytes"] == len(SALES) and [s["rows_out"] for s in m["stages"]] == [4, 4, 3, 3, 2]
    assert cli.main(["validate", str(spec)]) == 0 and cli.main(["run", str(spec), "--dry-run"]) == 0
    assert "3. aggregate" in capsys.readouterr().out
    spec.write_text(SPEC.format(sales).replace("rows_at_least = 1", "rows_at_least = 99"))
    assert cli.main(["run", str(spec), "--manifest", str(tmp_path / "m.json")]) == 1
    assert json.loads((tmp_path / "m.json").read_text())["status"] == "failed"


@pytest.mark.parametrize(
    "change, why",
    [
        (("[source.csv]", "[sorce.csv]"), "line 2.*did you mean 'source'"),
        (("[source.csv]", "[source.cvs]"), "did you mean 'csv'"),
        (('path = "{0}"', 'pth = "{0}"'), "line 3.*did you mean 'path'"),
        (("limit = 2", "limt = 2"), "line 18, column 1: stage #5.*did you mean 'limit'"),
        (("limit = 2", 'limit = "2"'), "must be integer"),
        (('"sum"', '"summ"'), "unknown aggregate.*did you mean 'sum'"),
        (("amount > 0", "amount >"), "stage #1"),
        (('["sum_amount"]', "[]"), "at least one column"),
        (("limit = 2", 'join = { right = "x", left_keys = ["a"], right_keys = ["a"], type = "" }'), "unknown type"),
        (("limit = 2", "sample = { fraction = 2.0, key = ['a'] }"), "between 0 and 1"),
        (("[[stages]]\nlimit = 2", "[[stages]\nlimit = 2"), "line 17"),
        (("\n[source", 'dead_letter = "x"\n[source'), "dead_letter"),
        (("\n[source", 'error_policy = "lax"\n[source'), "unknown error policy"),
    ],
)
def test_spec_errors(change, why):
    text = SPEC.replace(*change)
    with pytest.raises(ConfigError, match=f"(?s){why}"):
        specs.read_spec(text.replace("{{", "{").replace("}}", "}"), {"OUT": "x"})


def test_environment():
    env = {"A": "1"}
    assert specs.substitute({"${A}": ["${A}", "${B:-x y}", "$${A}", "${A:-z}", "${B:-}"]}, env) == {"${A}": ["1", "x y", "${A}", "1", ""]}
    with pytest.raises(ConfigError):
        specs.substitute("${B}", env)


def test_distance_and_schema():
    assert specs.distance("limt", "limit") == 1 and specs.distance("ab", "ba") == 1 and specs.distance("", "abc") == 3
    s = specs.json_schema()
    assert {next(iter(o["properties"])) for o in s["properties"]["stages"]["items"]["oneOf"]} == set(specs.STAGES)


def test_diff(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, None, 3), (None, "n", 0)], "id int, name string, only_a int")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w"), (None, "n")], "id int, name string")
    d = diff(a, b, ["id"])
    assert [tuple(r) for r in d.rows.collect()] == [("-", 1, "x"), ("-", 2, "y"), ("+", 2, "z"), ("+", 4, "w")]
    assert d.summary() == {"added": 1, "removed": 1, "changed": 1, "unchanged": 2}
    assert d.text() == "note: column 'only_a' is only in the first input\n1 added, 1 removed, 1 changed, 2 unchanged"
    for keys, left in ((["nope"], a), (["id"], a.union(a)), (["id"], a.withColumn("id", a.id.cast("string"))), ([], a)):
        with pytest.raises(MillraceError):
            diff(left, b, keys)
    same = diff(spark.sql("SELECT 1 AS k, 5 AS v"), spark.sql("SELECT 1 AS k, '5' AS v"), ["k"])
    assert same.summary()["unchanged"] == 1


def test_drift_and_tools(spark, sales, tmp_path, capsys):
    saved = str(tmp_path / "s.json")
    assert cli.main(["schema", sales, "--save", saved]) == 0
    assert cli.main(["schema", sales, "--against", saved]) == 0
    other = tmp_path / "o.csv"
    other.write_text("amount,region,extra\n1.5,x,1\n")
    capsys.readouterr()
    assert cli.main(["schema", str(other), "--against", saved]) == 2
    assert capsys.readouterr().out.splitlines() == ["removed column: product (string)", "added column: extra (int32)", "type changed: amount: int32 -> float64", "order changed: region, amount -> amount, region"]
    assert cli.main(["schema", sales]) == 0 and capsys.readouterr().out == "region\tstring\namount\tint32\nproduct\tstring\n"
    assert cli.main(["preview", sales, "--rows", "1"]) == 0 and capsys.readouterr().out == "region,amount,product\nwest,10,a\n"
    assert cli.main(["convert", sales, str(tmp_path / "c.jsonl")]) == 0 and len((tmp_path / "c.jsonl").read_text().splitlines()) == 5
    assert cli.main(["init", sales, "--out", str(tmp_path / "p.toml")]) == 0
    assert specs.read_spec((tmp_path / "p.toml").read_text()).stages[1][1]["no_nulls"] == ["region", "amount"]
    assert cli.main(["sql", f"SELECT SUM(amount) AS s FROM '{sales}'"]) == 0 and capsys.readouterr().out == "s\n42\n"
    assert cli.main(["sql", "SELECT nonsense"]) == 1
    assert cli.main(["doctor"]) == 0 and cli.main(["schema-json"]) == 0
    assert cli.main(["diff", sales, sales, "--key", "region"]) == 1
    with pytest.raises(ConfigError):
        tools.schema_load(sales)


def test_watch(tmp_path):
    f = tmp_path / "x"
    f.write_text("1")
    seen = []

    def act():
        seen.append(f.read_text())
        if len(seen) == 1:
            f.write_text("22")

    assert tools.watch([str(f)], act, 0.01, 4) == 2 and seen == ["1", "22"]


def test_metrics():
    m = Metrics()
    try:
        m(Event("source_batch", "source", 5, 5))
        m(Event("stage_batch", "filter", 5, 3))
        m.finish(2)
        text = urllib.request.urlopen(f"http://127.0.0.1:{m.port}/metrics").read().decode()
    finally:
        m.close()
    assert "millrace_rows 5\n" in text and 'millrace_stage_rows{stage="filter",dir="out"} 3\n' in text and "millrace_running 0\n" in text
    with pytest.raises(ConfigError):
        Metrics("0.0.0.0:0")


def test_sql_text_is_checked_first(spark):
    with pytest.raises(ExpressionError):
        Pipeline(spark).filter("1 +")
