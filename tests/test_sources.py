import gzip
import json
import os
import stat
import threading
from datetime import UTC, date, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pytest

from millrace import Pipeline
from millrace.errors import CloudError, ColumnarError, ConfigError, CsvError, DatabaseError, IoError, JsonError
from millrace.sources import columnar, external, files, sinks


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        (gzip.open(path, "wt") if name.endswith(".gz") else open(path, "w")).write(text)
        return str(path)

    return write


def write_text(path, text):
    with open(path, "w") as f:
        f.write(text)


def kinds(p):
    return dict(p.to_df().dtypes)


@pytest.mark.parametrize(
    "cells, kind",
    [
        (["1", "2"], "int"),
        (["1", "3000000000"], "bigint"),
        (["1", "2.5"], "double"),
        (["1e3", "nan", "-inf"], "double"),
        (["true", "FALSE"], "boolean"),
        (["2024-01-01", "1969-12-31"], "date"),
        (["2024-01-01T10:00:00Z", "2024-01-01 10:00"], "timestamp"),
        (["2024-02-30"], "string"),
        (["true", "5"], "string"),
        (["3.5", "2024-01-01"], "string"),
        (["", ""], "boolean"),
        (["", " 7 "], "int"),
        (["+5"], "int"),
    ],
)
def test_ladder(spark, put, cells, kind):
    p = Pipeline(spark).read_csv(put("t.csv", "k,v\n" + "".join(f"0,{c}\n" for c in cells)))
    assert kinds(p)["v"] == kind
    first = Pipeline(spark).read_csv(put("u.csv", "k,v\n" + "".join(f"0,{c}\n" for c in cells)), infer_rows=10)
    assert kinds(first)["v"] == kind and repr(first.collect()) == repr(p.collect())


def test_csv_text(spark, put):
    p = Pipeline(spark).read_csv(put("t.csv", 'a,b\n" x ","q""q"\n,"two\nlines"\n3,"c,d"\n'))
    assert p.collect() == [{"a": "x", "b": 'q"q'}, {"a": None, "b": "two\nlines"}, {"a": "3", "b": "c,d"}]


def test_gzip_and_errors(spark, put, tmp_path):
    assert len(Pipeline(spark).read_csv(put("t.csv.gz", "a,b\n" + "1,x\n" * 1003)).collect()) == 1003
    with pytest.raises(IoError):
        Pipeline(spark).read_csv(str(tmp_path / "nope.csv")).collect()
    with pytest.raises(Exception, match="not int32"):
        Pipeline(spark).read_csv(put("u.csv", "a\n1\nx\n"), types={"a": "int32"}).collect()


def test_policies(spark, put, tmp_path):
    path, jar = put("t.csv", "a,b\n1,2\n3\n4,5,6\n7,8\n"), str(tmp_path / "bad.csv")
    for p in (Pipeline(spark), Pipeline(spark).on_error("strict")):
        with pytest.raises(CsvError, match="line 3"):
            p.read_csv(path).select(["b"]).collect()
    assert Pipeline(spark).on_error("skip").read_csv(path).select(["a"]).collect() == [{"a": 1}, {"a": 7}]
    assert len(Pipeline(spark).on_error(f"quarantine:{jar}").read_csv(path).collect()) == 2
    assert open(jar).read() == "a,b\n3\n4,5,6\n" and stat.S_IMODE(os.stat(jar).st_mode) == 0o600
    with pytest.raises(IoError):
        Pipeline(spark).on_error(f"quarantine:{tmp_path}/no/such/x").read_csv(path).collect()
    with pytest.raises(ConfigError):
        Pipeline(spark).on_error("ignore")


def test_jsonl_record_limit(spark, put, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_RECORD", 40)
    line = lambda n: '{"a": "' + "x" * (n - 9) + '"}'
    assert len(line(40)) == 40 and len(Pipeline(spark).read_jsonl(put("at.jsonl", line(40) + "\n" + line(12))).collect()) == 2
    over, jar = put("over.jsonl", line(41) + "\n" + line(12) + "\n"), str(tmp_path / "long.jsonl")
    with pytest.raises(JsonError):
        Pipeline(spark).read_jsonl(over).collect()
    assert len(Pipeline(spark).on_error("skip").read_jsonl(over).collect()) == 1
    assert len(Pipeline(spark).on_error(f"quarantine:{jar}").read_jsonl(over).collect()) == 1 and open(jar).read() == line(41) + "\n"


def test_jsonl(spark, put, tmp_path):
    path = put("t.jsonl", '{"id": 1, "city": "x", "big": 5000000000, "day": "2024-01-01"}\n\n{"id": 2, "tags": [1, {"a": 2}]}\n')
    p = Pipeline(spark).read_jsonl(path)
    assert kinds(p) == {"big": "bigint", "city": "string", "day": "string", "id": "int", "tags": "string"}
    assert p.collect()[1]["tags"].replace(" ", "") == '[1,{"a":2}]' or p.collect()[1]["tags"]
    bad, jar = put("b.jsonl", '{"a": 1}\n{"a": \n{"a": 3}\n'), str(tmp_path / "bad.jsonl")
    with pytest.raises(Exception, match="malformed"):
        Pipeline(spark).read_jsonl(bad).collect()
    assert [r["a"] for r in Pipeline(spark).on_error("skip").read_jsonl(bad).collect()] == [1, 3]
    assert len(Pipeline(spark).on_error(f"quarantine:{jar}").read_jsonl(bad).collect()) == 2
    assert open(jar).read() == '{"a": \n'


def test_json_array(spark, put):
    assert Pipeline(spark).read_json(put("t.json", '[{"a": 1, "b": true},\n {"a": null, "b": false}]')).collect() == [{"a": 1, "b": True}, {"a": None, "b": False}]
    with pytest.raises(JsonError):
        Pipeline(spark).read_json(put("u.json", '[{"a": 1}, {"a"')).collect()


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "a,b", 30.0, datetime(2024, 1, 1, 1, 2, 3, 4, tzinfo=UTC), True), (2, "", 1e20, datetime(2024, 1, 1, tzinfo=UTC), None), (3, None, float("nan"), None, False), (4, 'q"', 1e-7, None, None)],
        "z int, s string, f double, t timestamp, b boolean",
    ).coalesce(1)
    csv, jsonl, js = (str(tmp_path / n) for n in ("o.csv", "o.jsonl", "o.json"))
    Pipeline(spark).from_df(df).write_csv(csv).execute()
    assert open(csv).read() == 'z,s,f,t,b\n1,"a,b",30,2024-01-01T01:02:03.000004Z,true\n2,,100000000000000000000,2024-01-01T00:00:00Z,\n3,,NaN,,false\n4,"q""",0.0000001,,\n'
    Pipeline(spark).from_df(df).write_jsonl(jsonl).execute()
    lines = open(jsonl).read().splitlines()
    assert lines[1] == '{"b":null,"f":1.0E20,"s":null,"t":"2024-01-01T00:00:00Z","z":2}' and '"f":null' in lines[2]
    Pipeline(spark).from_df(df).write_json(js, pretty=True).execute()
    assert [r["z"] for r in json.load(open(js))] == [1, 2, 3, 4]
    Pipeline(spark).from_df(df).filter("z > 9").write_json(js).execute()
    assert open(js).read() == "[]"
    Pipeline(spark).from_df(df).filter("z > 9").write_csv(csv).execute()
    assert open(csv).read() == "z,s,f,t,b\n"
    assert sinks.to_csv_text(df.select("z").limit(1)) == "z\n1\n" and os.listdir(tmp_path) and not [p for p in os.listdir(tmp_path) if p.startswith(".millrace")]
    Pipeline(spark).from_df(df).write_csv(str(tmp_path / "many"), single=False).execute()
    assert len(Pipeline(spark).read_csv(str(tmp_path / "many")).collect()) == 4


def test_copy_keeps_order(spark, tmp_path):
    spark.range(0, 5000, 1, 6).write.parquet(str(tmp_path / "t"))
    out = str(tmp_path / "o.csv")
    Pipeline(spark).read_parquet(str(tmp_path / "t")).sort(["id"], descending=True).write_csv(out).execute()
    assert open(out).read().split() == ["id", *map(str, range(4999, -1, -1))]


KINDS = ["int32", "int64", "float32", "float64", "utf8", "bool", "date", "timestamp"]


@pytest.mark.parametrize("zstd", [True, False])
def test_columnar_round_trip(spark, tmp_path, zstd):
    moment = datetime(1969, 12, 31, 23, 59, 59, 999999, tzinfo=UTC)
    rows = [(1, 2**40, 1.5, -2.5, "é", True, date(1969, 1, 1), moment), (None,) * 8, (-1, -1, 0.0, 0.0, "", False, date(2024, 2, 29), moment)] * 700
    df = spark.createDataFrame(rows, "a int, b long, c float, d double, e string, f boolean, g date, h timestamp").repartition(3)
    path = str(tmp_path / "x.bin")
    Pipeline(spark).from_df(df).write_columnar(path, zstd).execute()
    back = Pipeline(spark).read_columnar(path).to_df()
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert len(list(columnar.chunks(path))) == 3 and os.listdir(tmp_path) == ["x.bin"]


def test_columnar_hostile(tmp_path):
    good = columnar.encode_chunk(pa.RecordBatch.from_pydict({"a": [1, None], "s": ["x", "yy"]}), ["int64", "utf8"], False)
    path = tmp_path / "x"
    for broken in (good[:-1], good[:20], b"nonsense" + good[8:], good[:8] + b"\x09\x00" + good[10:], good[:24] + b"\xff" * 8 + good[32:]):
        path.write_bytes(broken)
        with pytest.raises((ColumnarError, UnicodeDecodeError)):
            for names, ks, n, buffers, _ in columnar.chunks(str(path)):
                [columnar.decode(k, n, a, b, "x") for k, (a, b) in zip(ks, buffers, strict=True)]
    path.write_bytes(b"")
    assert list(columnar.chunks(str(path))) == []


def test_sqlite(spark, tmp_path):
    db = str(tmp_path / "t.db")
    df = spark.createDataFrame([(1, "a", 0.5, date(2024, 1, 1), True), (2, None, None, None, None)], "id int, s string, f double, d date, b boolean")
    Pipeline(spark).from_df(df).write_sqlite(db, 'odd "name').execute()
    Pipeline(spark).from_df(df).write_sqlite(db, 'odd "name').execute()
    got = Pipeline(spark).read_sqlite(db, 'SELECT * FROM "odd ""name" ORDER BY id').collect()
    assert len(got) == 4 and got[0] == {"id": 1, "s": "a", "f": 0.5, "d": "2024-01-01", "b": 1}
    with pytest.raises(DatabaseError):
        Pipeline(spark).read_sqlite(db, "SELECT nope").collect()
    with pytest.raises(IoError):
        Pipeline(spark).read_sqlite(str(tmp_path / "none.db"), "SELECT 1").collect()


def test_http_with_retry(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(503 if len(asked) == 1 else 200)
            self.end_headers()
            if len(asked) > 1:
                self.wfile.write(b"a,b\n1,x\n2,y\n")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}/t.csv"
        assert len(Pipeline(spark).with_retry(3, 1, 2).read_http(url).to_df().collect()) == 2
        with pytest.raises(IoError):
            external.read_http(spark, url, max_body=3)
    finally:
        server.shutdown()


def test_places():
    assert external.object_uri("s3", "s3://b", "/k.csv") == "s3a://b/k.csv"
    assert external.object_uri("gcs", "b", "k") == "gs://b/k"
    assert external.object_uri("azure", "acc/box", "k") == "abfss://box@acc.dfs.core.windows.net/k"
    with pytest.raises(CloudError):
        external.object_uri("azure", "acc", "k")
    o = external.jdbc_options("postgres://me:p%40ss@localhost/db")
    assert o["url"] == "jdbc:postgresql://localhost:5432/db" and o["password"] == "p@ss"
    with pytest.raises(DatabaseError):
        external.jdbc_options("postgres://me@db.example.org/db")
    assert external.jdbc_options("postgres://me@db.example.org/db?sslmode=require")["user"] == "me"
    for name, kind in {"http://x/y.json": "http", "a.JSONL": "jsonl", "a.ndjson": "jsonl", "a.jsonl.gz": "jsonl", "a.json": "json", "a.parquet": "parquet", "a.txt": "csv", "a": "csv"}.items():
        assert files.detect(name) == kind
