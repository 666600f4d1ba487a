"""Queries over the test tables, at least one for each operator, with the SQL that says the same."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CsvError, DataQualityError, MillraceError
from ..operators.quality import HasType, NoNulls, OneOf, Range, RowsAtLeast, RowsAtMost, Unique
from ..operators.stages import AggSpec
from ..streaming.runs import run_available
from .diff import diff
from .pipeline import Pipeline
from .sql import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def scan(spark: SparkSession, d: str, table: str) -> Pipeline:
    return Pipeline(spark).read_parquet(f"{d}/{table}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scan(spark, sf_dir, "events").filter("value > 100 and event_type != 'error'")
    return p.aggregate(["event_type"], [AggSpec("sum", "value"), AggSpec("count_all")]).sort(["sum_value"], descending=True).to_df()


@query("SELECT event_type, round(sum(value), 4) AS sum_value, count(*) AS count_all FROM events WHERE value > 100 AND event_type <> 'error' GROUP BY event_type")
def q00_flagship(spark, d):
    return flagship(spark, d).withColumn("sum_value", F.round("sum_value", 4))


@query("SELECT * FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.05")
def q01_filter_and(spark, d):
    return scan(spark, d, "lineitem").filter("l_quantity > 45 and l_discount < 0.05").to_df()


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 1 = 0 THEN NULL ELSE CAST(trunc(1.0 / (l_linenumber - 1)) AS BIGINT) END AS z FROM lineitem)
    SELECT l_orderkey, l_linenumber, (z = 1) OR l_linenumber = 1 AS either, NOT (z = 1) AS neither, (z = 1) AND l_linenumber = 3 AS both FROM t"""
)
def q02_kleene(spark, d):
    p = scan(spark, d, "lineitem").map({"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "z": "1 / (l_linenumber - 1)"})
    return p.map({"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "either": "z == 1 or l_linenumber == 1", "neither": "not (z == 1)", "both": "z == 1 and l_linenumber == 3"}).to_df()


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01 00:00:00'")
def q03_date_literal(spark, d):
    return scan(spark, d, "lineitem").filter("l_shipdate >= '1995-06-01T00:00:00'").select(["l_orderkey", "l_linenumber", "l_shipdate"]).to_df()


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def q04_arithmetic(spark, d):
    return scan(spark, d, "lineitem").map({"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "revenue": "l_extendedprice * (1 - l_discount)"}).to_df()


@query("SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, -(o_orderkey % 5) AS n FROM orders")
def q05_integer_division(spark, d):
    return scan(spark, d, "orders").map({"o_orderkey": "o_orderkey", "q": "o_orderkey / 7", "r": "o_orderkey % 7", "n": "-(o_orderkey % 5)"}).to_df()


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'inf'::DOUBLE WHEN c_acctbal < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS x FROM customer")
def q06_float_by_zero(spark, d):
    return scan(spark, d, "customer").map({"c_custkey": "c_custkey", "x": "c_acctbal / (c_acctbal - c_acctbal)"}).to_df()


@query("SELECT c_custkey, c_name || '-' || c_mktsegment AS label FROM customer")
def q07_concat(spark, d):
    return scan(spark, d, "customer").map({"c_custkey": "c_custkey", "label": "c_name + '-' + c_mktsegment"}).to_df()


@query("SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS INTEGER) AS n, trim('  ' || c_mktsegment || '  ') AS t FROM customer")
def q08_text_functions(spark, d):
    return scan(spark, d, "customer").map({"c_custkey": "c_custkey", "u": "upper(c_name)", "l": "lower(c_mktsegment)", "n": "length(c_name)", "t": "trim('  ' + c_mktsegment + '  ')"}).to_df()


@query("SELECT c_custkey, abs(c_acctbal) AS a, sqrt(abs(c_acctbal)) AS s, -c_acctbal AS n FROM customer")
def q09_math_functions(spark, d):
    return scan(spark, d, "customer").map({"c_custkey": "c_custkey", "a": "abs(c_acctbal)", "s": "sqrt(abs(c_acctbal))", "n": "-c_acctbal"}).to_df()


@query("SELECT s_suppkey, greatest(s_acctbal, 0.0) AS hi, least(s_acctbal, 5000.0) AS lo FROM supplier")
def q10_min_max_of_row(spark, d):
    return scan(spark, d, "supplier").map({"s_suppkey": "s_suppkey", "hi": "max(s_acctbal, 0.0)", "lo": "min(s_acctbal, 5000.0)"}).to_df()


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side, coalesce(NULL, c_name) AS name FROM customer")
def q11_if_coalesce(spark, d):
    return scan(spark, d, "customer").map({"c_custkey": "c_custkey", "side": "if(c_acctbal < 0, 'debt', 'credit')", "name": "coalesce(null, c_name)"}).to_df()


@query("SELECT o_totalprice, o_orderkey FROM orders")
def q12_select(spark, d):
    return scan(spark, d, "orders").select(["o_totalprice", "o_orderkey", "o_custkey"]).drop(["o_custkey", "not_there"]).to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
def q13_top_k(spark, d):
    return scan(spark, d, "orders").sort(["o_totalprice", "o_orderkey"], descending=True).limit(50).select(["o_orderkey", "o_totalprice"]).to_df()


@query("SELECT * FROM events WHERE event_id < 100")
def q14_limit_in_order(spark, d):
    return scan(spark, d, "events").limit(100).to_df()


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem GROUP BY ALL")
def q15_sum(spark, d):
    p = scan(spark, d, "lineitem").aggregate(["l_returnflag", "l_linestatus"], [AggSpec("sum", "l_quantity"), AggSpec("sum", "l_linenumber")])
    return p.to_df().withColumn("sum_l_quantity", F.round("sum_l_quantity", 2))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_discount), 8) AS avg_l_discount FROM lineitem GROUP BY ALL")
def q16_avg(spark, d):
    return scan(spark, d, "lineitem").group_by(["l_returnflag", "l_linestatus"]).agg({"l_discount": "avg"}).to_df().withColumn("avg_l_discount", F.round("avg_l_discount", 8))


@query("SELECT l_returnflag, count(CASE WHEN l_linenumber <> 1 THEN 1 END) AS count_z FROM lineitem GROUP BY ALL")
def q17_count_skips_null(spark, d):
    return scan(spark, d, "lineitem").map({"l_returnflag": "l_returnflag", "z": "if(l_linenumber == 1, null, l_linenumber)"}).group_by(["l_returnflag"]).agg({"z": "count"}).to_df()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def q18_count_all(spark, d):
    return scan(spark, d, "lineitem").aggregate(["l_returnflag", "l_linestatus"], [AggSpec("count_all", output="n")]).to_df()


@query("SELECT l_returnflag, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_shipmode) AS min_l_shipmode FROM (SELECT l_returnflag, l_quantity, l_linestatus AS l_shipmode FROM lineitem) GROUP BY ALL")
def q19_min_max(spark, d):
    p = scan(spark, d, "lineitem").map({"l_returnflag": "l_returnflag", "l_quantity": "l_quantity", "l_shipmode": "l_linestatus"})
    return p.aggregate(["l_returnflag"], [AggSpec("min", "l_quantity"), AggSpec("max", "l_quantity"), AggSpec("min", "l_shipmode")]).to_df()


@query("SELECT user_id, min(ts) AS min_ts, max(ts) AS max_ts FROM events GROUP BY user_id")
def q20_min_max_time(spark, d):
    return scan(spark, d, "events").aggregate(["user_id"], [AggSpec("min", "ts"), AggSpec("max", "ts")]).to_df()


@query("SELECT count(*) AS count_all, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last FROM orders")
def q21_global(spark, d):
    p = scan(spark, d, "orders").aggregate([], [AggSpec("count_all"), AggSpec("sum", "o_totalprice", "total"), AggSpec("max", "o_orderkey", "last")])
    return p.to_df().withColumn("total", F.round("total", 2))


@query(
    """SELECT k, count(*) AS count_all, round(sum(v), 2) AS sum_v FROM
    (SELECT CASE WHEN o_totalprice > 250000 THEN o_orderpriority END AS k, CASE WHEN o_totalprice <= 250000 THEN o_totalprice END AS v FROM orders) GROUP BY k"""
)
def q22_null_groups(spark, d):
    p = scan(spark, d, "orders").map({"k": "if(o_totalprice > 250000, o_orderpriority, null)", "v": "if(o_totalprice <= 250000, o_totalprice, null)"})
    return p.aggregate(["k"], [AggSpec("count_all"), AggSpec("sum", "v")]).to_df().withColumn("sum_v", F.round("sum_v", 2))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 200")
def q23_sort_mixed(spark, d):
    return scan(spark, d, "customer").sort(["c_mktsegment", "c_acctbal", "c_custkey"], descending=[False, True, False]).limit(200).select(["c_mktsegment", "c_custkey", "c_acctbal"]).to_df()


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def q24_dedup_first(spark, d):
    return scan(spark, d, "events").dedup(["user_id"]).to_df()


@query("SELECT DISTINCT text FROM documents")
def q25_dedup_rows(spark, d):
    return scan(spark, d, "documents").select(["text"]).dedup([]).to_df()


#: Orders as the left side: dear ones have a key that no customer has, those in process none at all.
_KEY = "if(o_orderstatus == 'P', null, if(o_totalprice > 300000, o_custkey + 100000000, o_custkey))"
_ORDERS = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_totalprice > 300000 THEN o_custkey + 100000000 ELSE o_custkey END AS k FROM orders"


def _join(spark, d, how):
    right = scan(spark, d, "customer").select(["c_custkey", "c_name"])
    return scan(spark, d, "orders").map({"o_orderkey": "o_orderkey", "k": _KEY}).join(right, ["k"], ["c_custkey"], how).to_df()


def _join_sql(how):
    return f"SELECT o_orderkey, k, c_custkey, c_name FROM ({_ORDERS}) o {how} JOIN customer c ON k = c_custkey"


@query(_join_sql("INNER"))
def q26_join_inner(spark, d):
    return _join(spark, d, "inner")


@query(_join_sql("LEFT"))
def q27_join_left(spark, d):
    return _join(spark, d, "left")


@query(_join_sql("RIGHT"))
def q28_join_right(spark, d):
    return _join(spark, d, "right")


@query(_join_sql("FULL"))
def q29_join_full(spark, d):
    return _join(spark, d, "full")


@query(
    """SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_orderkey AS l_orderkey_r, b.l_linenumber AS l_linenumber_r, b.l_tax AS l_tax
    FROM lineitem a JOIN (SELECT * FROM lineitem WHERE l_quantity > 40) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"""
)
def q30_join_composite(spark, d):
    right = scan(spark, d, "lineitem").filter("l_quantity > 40").select(["l_orderkey", "l_linenumber", "l_tax"])
    return scan(spark, d, "lineitem").select(["l_orderkey", "l_linenumber", "l_quantity"]).join(right, ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"]).to_df()


@query("SELECT d.doc_id, d.lang, l.doc_id AS doc_id_r, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def q31_join_names(spark, d):
    right = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic")
    return scan(spark, d, "documents").select(["doc_id", "lang"]).join(right, ["doc_id"], ["doc_id"]).to_df()


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10"""
)
def q32_revenue_by_nation(spark, d):
    supplier = scan(spark, d, "supplier").select(["s_suppkey", "s_nationkey"])
    nation = scan(spark, d, "nation").select(["n_nationkey", "n_name"])
    p = scan(spark, d, "lineitem").map({"l_suppkey": "l_suppkey", "r": "l_extendedprice * (1 - l_discount)"})
    p = p.join(supplier, ["l_suppkey"], ["s_suppkey"]).join(nation, ["s_nationkey"], ["n_nationkey"])
    p = p.aggregate(["n_name"], [AggSpec("sum", "r", "revenue")]).sort(["revenue", "n_name"], descending=[True, False]).limit(10)
    return p.to_df().withColumn("revenue", F.round("revenue", 2))


def _fnv_sql(seed: int, key: str) -> str:
    """The keyed sample's position in 128-bit arithmetic: FNV-1a over the seed and a bigint key, then SplitMix64."""
    m = "18446744073709551616::UHUGEINT"
    step = f"((xor(s, b) * 1099511628211::UHUGEINT) % {m})"
    data = f"list_concat([{', '.join(f'{(seed >> 8 * i) & 255}::UHUGEINT' for i in range(8))}], [(({key} // (256 ** i)::BIGINT) % 256)::UHUGEINT FOR i IN range(7)], [0::UHUGEINT])"
    state = f"list_reduce(list_concat([14695981039346656037::UHUGEINT], {data}), lambda s, b: {step})"
    return f"""SELECT *, xor(z2, z2 // 2147483648::UHUGEINT) // 2048::UHUGEINT AS top FROM (SELECT *, (xor(z1, z1 // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {m} AS z2 FROM (
        SELECT *, (xor(z0, z0 // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {m} AS z1 FROM (SELECT *, ({state} + 11400714819323198485::UHUGEINT) % {m} AS z0 FROM events)))"""


@query(f"SELECT event_id, ts, user_id, event_type, value, props FROM ({_fnv_sql(7, 'event_id')}) WHERE top::DOUBLE / 9007199254740992.0 < 0.25")
def q33_sample(spark, d):
    return scan(spark, d, "events").sample(0.25, "event_id", seed=7).to_df()


@query("SELECT * FROM orders")
def q34_expect(spark, d):
    checks = [RowsAtLeast(1), RowsAtMost(10**12), NoNulls("o_orderkey"), Unique("o_orderkey"), Range("o_totalprice", 0, None), HasType("o_orderkey", "int64")]
    return scan(spark, d, "orders").expect(*checks, OneOf("o_orderstatus", ("F", "O", "P"))).to_df()


def _sql(spark, d, text, *tables):
    return sql(text, spark, {t: f"{d}/{t}.parquet" for t in tables})


def _same(name: str, text: str, table: str, oracle: str | None = None) -> None:
    f = lambda spark, d: _sql(spark, d, text, table)
    f.__name__ = name
    query(oracle or text)(f)


_same("q35_sql_projection", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders", "orders")
_same("q36_sql_where", "SELECT o_orderkey FROM orders WHERE NOT o_totalprice > 100000 AND o_orderkey % 2 = 1 OR o_orderkey < 10", "orders")
_same(
    "q37_sql_is_null",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE 10 / (l_linenumber - 1) IS NULL OR (l_linenumber > 5) IS TRUE",
    "lineitem",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 OR (l_linenumber > 5) IS TRUE",
)
_same("q38_sql_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "orders")
_same("q39_sql_group_by", "SELECT MAX(o_totalprice) AS top, o_orderstatus, COUNT(*) AS n, COUNT(o_custkey) FROM orders GROUP BY o_orderstatus", "orders", "SELECT max(o_totalprice) AS top, o_orderstatus, count(*) AS n, count(o_custkey) AS count_o_custkey FROM orders GROUP BY o_orderstatus")
_same("q40_sql_order_mixed", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_custkey ASC LIMIT 75", "customer")
_same("q41_sql_limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20", "orders")
_same("q42_sql_star_and_more", "SELECT *, n_nationkey + 1 AS next FROM nation WHERE n_name <> 'it''s'", "nation")


_MOVED, _DEARER = "CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 100000000 ELSE s_suppkey END", "CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal + 1 ELSE s_acctbal END"


@query(
    f"""WITH a AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier), b AS (SELECT {_MOVED} AS s_suppkey, s_name, {_DEARER} AS s_acctbal FROM supplier)
    SELECT '-' AS _diff, a.* FROM a LEFT JOIN b USING (s_suppkey) WHERE b.s_name IS NULL OR a.s_acctbal IS DISTINCT FROM b.s_acctbal
    UNION ALL SELECT '+' AS _diff, b.* FROM b LEFT JOIN a USING (s_suppkey) WHERE a.s_name IS NULL OR a.s_acctbal IS DISTINCT FROM b.s_acctbal"""
)
def q43_diff(spark, d):
    a = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal")
    b = a.select(F.expr(_MOVED).alias("s_suppkey"), "s_name", F.expr(_DEARER).alias("s_acctbal"))
    return diff(a, b, ["s_suppkey"]).rows


def _folder(spark: SparkSession) -> str:
    """A new folder that executors see too: in the shared folder, if the session names one that the driver can write to."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    if shared.startswith("/"):
        os.makedirs(shared, exist_ok=True)
    return tempfile.mkdtemp(prefix="millrace-", dir=shared if shared.startswith("/") else None)


@query("SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, r_name FROM region")
def q44_csv_round_trip(spark, d):
    path = os.path.join(_folder(spark), "region.csv")
    scan(spark, d, "region").write_csv(path).execute()
    return Pipeline(spark).read_csv(path).select(["r_regionkey", "r_name"]).to_df()


@query("SELECT n_name, CAST(n_nationkey AS INTEGER) AS n_nationkey FROM nation")
def q45_jsonl_round_trip(spark, d):
    path = os.path.join(_folder(spark), "nation.jsonl")
    scan(spark, d, "nation").write_jsonl(path).execute()
    return Pipeline(spark).read_jsonl(path).select(["n_name", "n_nationkey"]).to_df()


@query("SELECT n_name, CAST(n_nationkey AS INTEGER) AS n_nationkey FROM nation")
def q46_json_round_trip(spark, d):
    path = os.path.join(_folder(spark), "nation.json")
    scan(spark, d, "nation").write_json(path, pretty=True).execute()
    return Pipeline(spark).read_json(path).select(["n_name", "n_nationkey"]).to_df()


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def q47_columnar_round_trip(spark, d):
    path = os.path.join(_folder(spark), "supplier.bin")
    scan(spark, d, "supplier").select(["s_suppkey", "s_name", "s_acctbal"]).write_columnar(path).execute()
    return Pipeline(spark).read_columnar(path).to_df()


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def q48_sqlite_round_trip(spark, d):
    path = os.path.join(_folder(spark), "supplier.db")
    scan(spark, d, "supplier").select(["s_suppkey", "s_name", "s_acctbal"]).write_sqlite(path, "supplier").execute()
    return Pipeline(spark).read_sqlite(path, "SELECT * FROM supplier").to_df()


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS count_all FROM events WHERE value > 50 GROUP BY event_type")
def q49_stream_available_now(spark, d):
    return run_available(spark, spark.read.parquet(f"{d}/events.parquet").schema, f"{d}/events.parque*", lambda df: Pipeline(spark).from_df(df).filter("value > 50").aggregate(["event_type"], [AggSpec("count_all")]), ["event_type"])


@query("SELECT c_custkey, c_acctbal * 2 AS doubled FROM customer WHERE c_acctbal > 0")
def q50_closures(spark, d):
    p = scan(spark, d, "customer").select(["c_custkey", "c_acctbal"]).filter_fn(lambda r: r["c_acctbal"] > 0)
    return p.map_fn({"c_custkey": "int64", "doubled": "float64"}, lambda r: (r["c_custkey"], r["c_acctbal"] * 2)).to_df()


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 20")
def q51_union_and_custom(spark, d):
    nation = scan(spark, d, "nation").select(["n_nationkey", "n_name"]).to_df()
    return Pipeline(spark).from_df(nation.where("n_nationkey < 5")).transform(lambda df: df.unionByName(nation.where("n_nationkey > 20"))).to_df()


@query("SELECT user_id, event_id FROM (SELECT * FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1)")
def q52_sort_then_dedup(spark, d):
    return scan(spark, d, "events").filter("event_type == 'click'").sort(["value"], descending=True).dedup(["user_id"]).select(["user_id", "event_id"]).to_df()


@query("SELECT event_id FROM events WHERE event_id IN (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 40) ORDER BY event_id LIMIT 40")
def q53_sort_map_limit(spark, d):
    return scan(spark, d, "events").sort(["value"], descending=True).map({"event_id": "event_id"}).limit(40).to_df()


@query("SELECT o_orderpriority, count(*) AS count_all, CAST(max(o_custkey) AS BIGINT) AS max_o_custkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 3")
def q54_toml_spec(spark, d):
    from .spec import build, read_spec

    text = f"""
    [source]
    parquet = "{d}/orders.parquet"
    [[stages]]
    filter = "o_totalprice > 1000 and o_orderstatus != 'P'"
    [[stages]]
    expect = {{ rows_at_least = 1, no_nulls = ["o_orderkey"] }}
    [[stages]]
    aggregate = {{ group_by = ["o_orderpriority"], aggs = {{ o_custkey = "max", "*" = "count_all" }} }}
    [[stages]]
    sort = {{ columns = ["o_orderpriority"] }}
    [[stages]]
    limit = 3
    """
    return build(read_spec(text), spark).to_df()


def _nations_with_faults(spark, d) -> str:
    """A CSV file of the nations (25 rows at any scale), in which every fourth row has a cell too many."""
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    path = os.path.join(_folder(spark), "nation.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("n_nationkey,n_name\n")
        f.writelines(f"{r.n_nationkey},{r.n_name}{',extra' if r.n_nationkey % 4 == 1 else ''}\n" for r in rows)
    return path


@query("SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation WHERE n_nationkey % 4 <> 1")
def q55_skip_malformed(spark, d):
    return Pipeline(spark).on_error("skip").read_csv(_nations_with_faults(spark, d)).to_df()


@query("SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name FROM supplier")
def q56_gzip(spark, d):
    path = os.path.join(_folder(spark), "supplier.csv")
    spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name").coalesce(1).write.option("header", True).option("compression", "gzip").csv(path)
    return Pipeline(spark).read_csv(f"{path}/*.csv.gz").to_df()


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:30:00'")
def q57_time_window(spark, d):
    return scan(spark, d, "events").filter("event_type == 'click' and ts >= '2024-01-02T00:00:00Z' and ts < '2024-01-20 14:30+02:00'").select(["event_id", "event_type"]).to_df()


@query("SELECT c.c_custkey, n.n_name, o.o_orderkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c.c_custkey = o.o_custkey")
def q58_join_chain(spark, d):
    nation = scan(spark, d, "nation").select(["n_nationkey", "n_name"])
    big = scan(spark, d, "orders").filter("o_totalprice > 400000").select(["o_orderkey", "o_custkey"])
    p = scan(spark, d, "customer").select(["c_custkey", "c_nationkey"]).join(nation, ["c_nationkey"], ["n_nationkey"]).join(big, ["c_custkey"], ["o_custkey"], "left")
    return p.select(["c_custkey", "n_name", "o_orderkey"]).to_df()


@query("SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q59_join_key_widths(spark, d):
    left = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("int"))
    return Pipeline(spark).from_df(left).join(scan(spark, d, "customer").select(["c_custkey", "c_name"]), ["o_custkey"], ["c_custkey"]).to_df()


@query("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey < 0) ON o_custkey = c_custkey")
def q60_join_empty_right(spark, d):
    right = scan(spark, d, "customer").filter("c_custkey < 0").select(["c_custkey", "c_name"])
    return scan(spark, d, "orders").select(["o_orderkey", "o_custkey"]).join(right, ["o_custkey"], ["c_custkey"], "left").to_df()


@query(
    """SELECT k, count(*) AS n FROM (SELECT CASE WHEN l_linenumber <> 1 THEN l_discount WHEN l_tax > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS k FROM lineitem) GROUP BY k"""
)
def q61_float_keys(spark, d):
    p = scan(spark, d, "lineitem").map({"k": "if(l_linenumber == 1, l_tax / (l_tax - l_tax), l_discount)"})
    return p.aggregate(["k"], [AggSpec("count_all", output="n")]).to_df()


_ODD = "CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey END"


@query(f"SELECT n_nationkey, {_ODD} AS k FROM nation ORDER BY k ASC NULLS FIRST, n_nationkey LIMIT 18")
def q62_sort_nulls_first(spark, d):
    p = scan(spark, d, "nation").map({"n_nationkey": "n_nationkey", "k": "if(n_nationkey % 2 == 1, n_nationkey, null)"})
    return p.sort(["k", "n_nationkey"]).limit(18).to_df()


@query(f"SELECT n_nationkey, {_ODD} AS k FROM nation ORDER BY k DESC NULLS LAST, n_nationkey DESC LIMIT 15")
def q63_sort_nulls_last(spark, d):
    p = scan(spark, d, "nation").map({"n_nationkey": "n_nationkey", "k": "if(n_nationkey % 2 == 1, n_nationkey, null)"})
    return p.sort(["k", "n_nationkey"], descending=True).limit(15).to_df()


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'nan'::DOUBLE ELSE n_nationkey * -1.5::DOUBLE END AS x FROM nation ORDER BY x, n_nationkey LIMIT 20")
def q64_sort_nan(spark, d):
    p = scan(spark, d, "nation").map({"n_nationkey": "n_nationkey", "x": "if(n_nationkey % 3 == 0, (n_nationkey * 0.0) / 0.0, n_nationkey * -1.5)"})
    return p.sort(["x", "n_nationkey"]).limit(20).to_df()


@query("SELECT n_nationkey, CAST(NULL AS VARCHAR) AS x FROM nation WHERE n_nationkey > 3")
def q65_missing_column(spark, d):
    return scan(spark, d, "nation").filter("coalesce(no_such, n_nationkey) > 3").map({"n_nationkey": "n_nationkey", "x": "no_such"}).to_df()


@query(
    """SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'ab' END AS a, CASE WHEN event_id % 2 = 0 THEN 'bc' ELSE 'c' END || event_type AS b FROM events)
    QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY event_id) = 1"""
)
def q66_dedup_keys_alike_when_joined(spark, d):
    p = scan(spark, d, "events").map({"event_id": "event_id", "a": "if(event_id % 2 == 0, 'a', 'ab')", "b": "if(event_id % 2 == 0, 'bc', 'c') + event_type"})
    return p.dedup(["a", "b"]).select(["event_id"]).to_df()


def _message(run: Callable[[], object]) -> str:
    """What a data-quality failure says; empty if there is none."""
    try:
        run()
    except DataQualityError as e:
        return str(e)
    return ""


@query(
    """WITH t AS (SELECT *, CASE WHEN c_acctbal >= 0 THEN c_custkey END AS k FROM customer), n AS (
        SELECT 1 AS i, 'rows >= 1000000000000' AS what, count(*) AS n FROM t
        UNION ALL SELECT 2, 'rows <= 1', count(*) FROM t
        UNION ALL SELECT 3, 'no nulls "k"', count(*) - count(k) FROM t
        UNION ALL SELECT 4, 'unique "c_nationkey"', count(*) - count(DISTINCT c_nationkey) FROM t
        UNION ALL SELECT 5, 'range "c_acctbal" [0, ]', count(*) FILTER (WHERE c_acctbal < 0) FROM t
        UNION ALL SELECT 6, 'one of "c_mktsegment" [''BUILDING'']', count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') FROM t)
    SELECT CAST(i AS BIGINT) AS i, 'check failed: ' || what || ': ' || n || ' row(s)' AS message FROM n
    UNION ALL SELECT 7, 'check failed: type "c_custkey" int32: it is int64'
    UNION ALL SELECT 8, 'check no nulls "no_such": column ''no_such'' not found; available: c_custkey, k'
    UNION ALL SELECT 9, 'check failed: rows <= 1: ' || count(*) || ' row(s)' FROM t
    UNION ALL SELECT 10, ''"""
)
def q67_failed_checks(spark, d):
    columns = {c: c for c in ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")}
    p = lambda: scan(spark, d, "customer").map(columns | {"k": "if(c_acctbal >= 0, c_custkey, null)"})
    failing = [RowsAtLeast(10**12), RowsAtMost(1), NoNulls("k"), Unique("c_nationkey"), Range("c_acctbal", 0), OneOf("c_mktsegment", ("BUILDING",)), HasType("c_custkey", "int32")]
    runs = [lambda c=c: p().expect(c).to_df() for c in failing]
    runs += [lambda: p().select(["c_custkey", "k"]).expect(NoNulls("no_such")).to_df()]
    runs += [lambda: p().expect(NoNulls("c_custkey"), RowsAtMost(1), NoNulls("k")).to_df(), lambda: p().expect(RowsAtLeast(1)).to_df()]
    return spark.createDataFrame([(i, _message(run)) for i, run in enumerate(runs, 1)], "i bigint, message string")


@query("SELECT 'n_nationkey,n_name' AS line UNION ALL SELECT n_nationkey || ',' || n_name || ',extra' FROM nation WHERE n_nationkey % 4 = 1")
def q68_quarantine(spark, d):
    path = _nations_with_faults(spark, d)
    Pipeline(spark).on_error(f"quarantine:{path}.bad").read_csv(path).to_df()
    return spark.read.text(f"{path}.bad").withColumnRenamed("value", "line")


@query("SELECT 'line 3: 3 fields, the header has 2' AS message")
def q69_strict(spark, d):
    path = _nations_with_faults(spark, d)
    try:
        Pipeline(spark).read_csv(path).collect()
        message = ""
    except CsvError as e:
        message = str(e).replace(f"{path}: ", "")
    return spark.createDataFrame([(message,)], "message string")


@query("SELECT 'map' AS _dead_letter_stage, 'ZeroDivisionError: division by zero' AS _error, CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation WHERE n_nationkey % 5 = 0")
def q70_dead_letters(spark, d):
    folder = _folder(spark)
    p = scan(spark, d, "nation").select(["n_nationkey", "n_name"]).map_fn({"x": "float64"}, lambda r: [10 / (r["n_nationkey"] % 5)])
    p.dead_letter(f"{folder}/dead.csv").write_csv(f"{folder}/out.csv").execute()
    return Pipeline(spark).read_csv(f"{folder}/dead.csv").to_df()


@query(
    """SELECT unnest(['removed column: o_custkey (int64)', 'added column: o_totalprice (float64)', 'type changed: o_orderkey: int64 -> string',
    'order changed: o_orderkey, o_orderstatus -> o_orderstatus, o_orderkey']) AS line"""
)
def q71_schema_drift(spark, d):
    from .. import tools

    path = os.path.join(_folder(spark), "schema.json")
    tools.schema_save(scan(spark, d, "orders").select(["o_orderkey", "o_custkey", "o_orderstatus"]).to_df(), path)
    now = spark.read.parquet(f"{d}/orders.parquet").select("o_orderstatus", F.col("o_orderkey").cast("string"), "o_totalprice")
    return spark.createDataFrame([(x,) for x in tools.schema_drift(tools.schema_load(path), tools.schema_of(now))], "line string")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def q72_preview(spark, d):
    p = scan(spark, d, "orders").select(["o_orderkey", "o_totalprice"]).sort(["o_totalprice", "o_orderkey"], descending=True)
    return spark.createDataFrame([(r["o_orderkey"], r["o_totalprice"]) for r in p.preview(10)], "o_orderkey bigint, o_totalprice double")


@query(
    """WITH t AS (SELECT count(*) AS a, count(*) FILTER (WHERE c_acctbal > 0) AS b FROM customer)
    SELECT 'source_batch' AS kind, a AS rows_in, a AS rows_out FROM t UNION ALL SELECT 'stage_batch', a, b FROM t
    UNION ALL SELECT 'sink_batch', b, b FROM t UNION ALL SELECT 'done', a, b FROM t"""
)
def q73_progress(spark, d):
    seen: list = []
    scan(spark, d, "customer").filter("c_acctbal > 0").on_progress(seen.append).execute()
    return spark.createDataFrame([(e.kind, e.rows_in, e.rows_out) for e in seen], "kind string, rows_in bigint, rows_out bigint")


_REFUSED = {
    "expression": ["1 +", "(1", "'abc", "1.2.3", "n_name $ 2", "no_such_function(n_name)", "(" * 65 + "1" + ")" * 65],
    "sql": [f"SELECT n_name FROM nation {x}" for x in ("WHERE", "HAVING n_name > 1", "LIMIT 1 OFFSET 2", "LIMIT 1.5", "extra stuff")] + ["SELECT SUM(*) FROM nation", "SELECT n_nationkey + 1 FROM nation"],
}


@query("SELECT 'expression' AS dialect, CAST(7 AS BIGINT) AS refused UNION ALL SELECT 'sql', 7")
def q74_refused_texts(spark, d):
    def refused(run: Callable[[], object]) -> bool:
        try:
            run()
        except MillraceError:
            return True
        return False

    n = sum(refused(lambda x=x: scan(spark, d, "nation").map({"x": x}).to_df()) for x in _REFUSED["expression"])
    m = sum(refused(lambda x=x: _sql(spark, d, x, "nation")) for x in _REFUSED["sql"])
    return spark.createDataFrame([("expression", n), ("sql", m)], "dialect string, refused bigint")


@query("SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_acctbal FROM supplier")
def q75_convert(spark, d):
    from .. import tools

    folder = _folder(spark)
    scan(spark, d, "supplier").select(["s_suppkey", "s_name", "s_acctbal"]).write_csv(f"{folder}/supplier.csv").execute()
    tools.convert(spark, f"{folder}/supplier.csv", f"{folder}/supplier.jsonl")
    return Pipeline(spark).read(f"{folder}/supplier.jsonl").to_df()


@query("SELECT count(*) AS count_all, sum(o_totalprice) AS total FROM orders WHERE FALSE")
def q76_empty_source(spark, d):
    nothing = spark.read.parquet(f"{d}/orders.parquet").limit(0)
    return Pipeline(spark).from_df(nothing).aggregate([], [AggSpec("count_all"), AggSpec("sum", "o_totalprice", "total")]).to_df()


@query("SELECT n_name FROM nation")
def q77_record_limit(spark, d):
    folder = _folder(spark)
    scan(spark, d, "nation").select(["n_name"]).write_jsonl(f"{folder}/nation.jsonl").execute()
    with open(f"{folder}/nation.jsonl", "a", encoding="utf-8") as f:
        f.write('{"n_name": "' + "x" * (17 << 20) + '"}\n')
    return Pipeline(spark).on_error("skip").read_jsonl(f"{folder}/nation.jsonl").to_df()


@query("SELECT count(*) AS n, 'source -> filter -> Sort -> limit -> sink' AS plan, 15 AS kept FROM orders")
def q78_discard_and_explain(spark, d):
    p = scan(spark, d, "orders").telemetry().filter("o_orderkey > 0").sort(["o_totalprice"]).limit(15)
    stats = p.execute()
    return spark.createDataFrame([(stats["rows"], re.sub(r"\s+", " ", p.explain()), p.stage_stats()[-1].rows_out)], "n bigint, plan string, kept int")
