"""The core surface's queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import results
from millrace.commands import literal
from millrace.operators import exchange
from millrace.operators.predicates import Between, Compare, In, IsNotNull, IsNull, Predicate, from_json, typed
from millrace.operators.relational import aggregate, join, limit, sort
from millrace.outcomes import ValidationError
from millrace.session import Engine, Session
from millrace.sources.files import Hadoop, files, joined
from millrace.sources.scan import renamed, scan
from millrace.sources.tablelog import TableLog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


@cache
def _own() -> str:
    path = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, path, True)
    return path


def _forget(path: str) -> None:
    try:
        files(path).remove(path)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        return


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        """A table, opened once."""
        df = self.__dict__[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df

    def folder(self, name: str) -> str:
        """A new folder for a logged table or a result, beside the session's checkpoints; a local one only where all run on this machine."""
        context = self.spark.sparkContext
        named = self.spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = _own()
        path = joined(named, "millrace", f"{name}-{uuid.uuid4().hex}")
        atexit.register(_forget, path)
        return path

    def engine(self, name: str = "warehouse") -> Engine:
        """An engine over a new root, with a database and schema."""
        engine = Engine(self.spark, self.folder(name))
        outcome = engine.run("create database w; create schema w.s")
        assert outcome.ok, outcome
        return engine

    def logged(self, df: DataFrame, by: str) -> TableLog:
        """The rows as a logged table, dealt to files by ranges of `by` so that statistics can tell them apart."""
        log = TableLog(self.folder("table"))
        log.create()
        log.append(df.repartitionByRange(8, by).sortWithinPartitions(by))
        return log


def where(df: DataFrame, p: Predicate) -> DataFrame:
    return df.where(typed(p, df.schema).column_expression())


def status(t: Tables) -> DataFrame:
    """Orders with a status that is NULL for some."""
    return t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("st"))


def dated(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


def counted(df: DataFrame) -> DataFrame:
    return aggregate(df, [], [("count", "*", "n")])


# scans and results


@query("SELECT r_regionkey, r_name FROM region")
def scan_full(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", "r_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1400 AND o_orderkey < 1500")
def scan_pruned(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey")
    return scan(t.spark, t.logged(orders, "o_orderkey"), orders.schema, Compare("o_orderkey", ">=", 1400) & Compare("o_orderkey", "<", 1500))


@query("SELECT n_nationkey, n_name FROM nation")
def scan_snapshot(t: Tables) -> DataFrame:
    nation = t.nation.select("n_nationkey", "n_name")
    log = t.logged(nation, "n_nationkey")
    version = log.versions()[-1]
    log.append(nation.limit(3))  # a later commit, which the snapshot doesn't see
    return scan(t.spark, log, nation.schema, version=version)


@query("SELECT r_regionkey AS c1, r_name AS c2 FROM region")
def scan_renamed(t: Tables) -> DataFrame:
    return renamed(t.region.select("r_regionkey", "r_name"), ["c1", "c2"])


@query("SELECT count(*) AS n FROM (SELECT r_name FROM region WHERE r_regionkey < 0) t")
def scan_empty(t: Tables) -> DataFrame:
    region = t.region.select("r_regionkey", "r_name")
    return counted(scan(t.spark, t.logged(region, "r_regionkey"), region.schema, Compare("r_regionkey", "<", 0)))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def materialize_roundtrip(t: Tables) -> DataFrame:
    path = t.folder("result")
    results.materialise(aggregate(t.orders, ["o_orderstatus"], [("count", "*", "n")]), path)
    return results.load(t.spark, path)


# projections


@query("SELECT c_custkey, c_name FROM customer")
def project_columns(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name")


@query("SELECT * FROM nation")
def project_star(t: Tables) -> DataFrame:
    return t.nation.select("*")


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def project_alias(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT count(*) AS n, o_orderstatus FROM orders GROUP BY o_orderstatus")
def project_agg_reorder(t: Tables) -> DataFrame:
    return aggregate(t.orders, ["o_orderstatus"], [("count", "*", "n")]).select("n", "o_orderstatus")


# filters


def _filter(name: str, table: str, column: str, p: Predicate) -> None:
    QUERIES[name] = lambda spark, sf_dir: where(getattr(Tables(spark, sf_dir), table), p).select(column)
    ORACLES[name] = f"SELECT {column} FROM {table} WHERE {p.sql()}"


_filter("filter_eq", "orders", "o_orderkey", Compare("o_orderstatus", "=", "F"))
_filter("filter_ne", "orders", "o_orderkey", Compare("o_orderstatus", "!=", "F"))
_filter("filter_lt", "part", "p_partkey", Compare("p_size", "<", 10))
_filter("filter_le", "part", "p_partkey", Compare("p_size", "<=", 10))
_filter("filter_gt", "part", "p_partkey", Compare("p_size", ">", 40))
_filter("filter_ge", "part", "p_partkey", Compare("p_size", ">=", 40))
_filter("filter_between_int", "part", "p_partkey", Between("p_size", 10, 20))
_filter("filter_between_str", "customer", "c_custkey", Between("c_mktsegment", "B", "H"))
_filter("filter_not_between", "part", "p_partkey", Between("p_size", 10, 20, negated=True))
_filter("filter_in_int", "part", "p_partkey", In("p_size", (1, 5, 9)))
_filter("filter_in_str", "customer", "c_custkey", In("c_mktsegment", ("BUILDING", "MACHINERY")))
_filter("filter_conjunction", "part", "p_partkey", Between("p_size", 5, 25) & In("p_type", ("ECONOMY", "STANDARD")) & Compare("p_brand", "!=", "Brand#1"))


@query("SELECT o_orderkey, d FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) t WHERE d BETWEEN '1997-01-01' AND '1997-03-31'")
def filter_between_date(t: Tables) -> DataFrame:
    return where(dated(t), Between("d", "1997-01-01", "1997-03-31"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS st FROM orders) t WHERE st IS NULL")
def filter_is_null(t: Tables) -> DataFrame:
    return where(status(t), IsNull("st")).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS st FROM orders) t WHERE st IS NOT NULL")
def filter_is_not_null(t: Tables) -> DataFrame:
    return where(status(t), IsNotNull("st")).select("o_orderkey")


@query("SELECT event_id, ts FROM events WHERE ts >= '2024-01-20 00:00:00'")
def filter_timestamp(t: Tables) -> DataFrame:
    return where(t.events.select("event_id", "ts"), Compare("ts", ">=", datetime(2024, 1, 20)))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) t WHERE d >= '2000-01-01'")
def filter_date(t: Tables) -> DataFrame:
    return where(dated(t), Compare("d", ">=", "2000-01-01")).select("o_orderkey")


# joins


def orders_customers(t: Tables) -> DataFrame:
    return join(t.orders, t.customer, [("o_custkey", "c_custkey")], "customer")


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_inner(t: Tables) -> DataFrame:
    return orders_customers(t).select("o_orderkey", "c_name")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def join_multi_key(t: Tables) -> DataFrame:
    left = t.lineitem.select("l_orderkey", "l_linenumber")
    both = join(left, t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")], "b")
    return both.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderdate = l.l_shipdate")
def join_timestamp_key(t: Tables) -> DataFrame:
    # few dates, each with many rows on both sides: count each side by date first, so no pair is ever made
    a = aggregate(t.orders, ["o_orderdate"], [("count", "*", "a")])
    b = aggregate(t.lineitem, ["l_shipdate"], [("count", "*", "b")])
    return join(a, b, [("o_orderdate", "l_shipdate")], "b").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n"))


@query("SELECT count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand")
def join_string_key(t: Tables) -> DataFrame:
    # a count over few, hot keys: count each side by key first, so no pair is ever made
    a = aggregate(t.part, ["p_brand"], [("count", "*", "a")])
    b = aggregate(t.part, ["p_brand"], [("count", "*", "b")])
    return join(a, b, [("p_brand", "p_brand")], "b").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n"))


@query("SELECT count(*) AS n FROM (SELECT nullif(r_regionkey, 0) AS k FROM region) a JOIN (SELECT nullif(n_regionkey, 0) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(t: Tables) -> DataFrame:
    a, b = t.region.select(F.nullif("r_regionkey", F.lit(0)).alias("k")), t.nation.select(F.nullif("n_regionkey", F.lit(0)).alias("k"))
    return counted(join(a, b, [("k", "k")], "nation", null_safe=True))


@query("SELECT a.n_nationkey AS n_nationkey, a.n_name AS n_name, b.n_nationkey AS nation_n_nationkey, b.n_name AS nation_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_duplicate_columns(t: Tables) -> DataFrame:
    return join(t.nation, t.nation, [("n_regionkey", "n_regionkey")], "nation").select("n_nationkey", "n_name", "nation_n_nationkey", "nation_n_name")


@query("SELECT count(*) AS n FROM region r JOIN nation n ON r.r_name = n.n_name")
def join_empty(t: Tables) -> DataFrame:
    return counted(join(t.region, t.nation, [("r_name", "n_name")], "nation"))


@query("SELECT c.c_mktsegment, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")
def join_group_by(t: Tables) -> DataFrame:
    return aggregate(orders_customers(t), ["c_mktsegment"], [("count", "*", "n")])


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' ORDER BY o.o_orderkey LIMIT 20")
def join_filter_sort_limit(t: Tables) -> DataFrame:
    return limit(sort(where(orders_customers(t), Compare("c_mktsegment", "=", "BUILDING")).select("o_orderkey", "c_name"), "o_orderkey"), 20)


@query("SELECT r.r_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
def join_chain(t: Tables) -> DataFrame:
    both = join(join(t.customer, t.nation, [("c_nationkey", "n_nationkey")], "nation"), t.region, [("n_regionkey", "r_regionkey")], "region")
    return aggregate(both, ["r_name"], [("count", "*", "n")])


# aggregates


def _aggregate(name: str, sql: str, table: str, keys: list[str], *aggs: tuple) -> None:
    QUERIES[name] = lambda spark, sf_dir: aggregate(getattr(Tables(spark, sf_dir), table), keys, list(aggs))
    ORACLES[name] = sql


_aggregate("agg_group_by", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey", "orders", ["o_custkey"], ("count", "*", "n"))
_aggregate("agg_count_star", "SELECT count(*) AS n FROM lineitem", "lineitem", [], ("count", "*", "n"))
_aggregate("agg_sum", "SELECT l_returnflag, sum(l_quantity) AS s FROM lineitem GROUP BY l_returnflag", "lineitem", ["l_returnflag"], ("sum", "l_quantity", "s"))
_aggregate("agg_min", "SELECT l_returnflag, min(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag", "lineitem", ["l_returnflag"], ("min", "l_extendedprice", "m"))
_aggregate("agg_max", "SELECT l_returnflag, max(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag", "lineitem", ["l_returnflag"], ("max", "l_extendedprice", "m"))
_aggregate("agg_global", "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem", "lineitem", [], ("count", "*", "n"), ("sum", "l_quantity", "s"), ("min", "l_discount", "lo"), ("max", "l_discount", "hi"))
_aggregate("agg_multi_key", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", "lineitem", ["l_returnflag", "l_linestatus"], ("count", "*", "n"))
_aggregate("agg_temporal_key", "SELECT o_orderdate, count(*) AS n FROM orders GROUP BY o_orderdate", "orders", ["o_orderdate"], ("count", "*", "n"))
_aggregate("agg_default_names", "SELECT o_orderstatus, count(*) AS count, CAST(sum(o_custkey) AS BIGINT) AS sum_o_custkey, max(o_custkey) AS max_o_custkey FROM orders GROUP BY o_orderstatus", "orders", ["o_orderstatus"], ("count", "*"), ("sum", "o_custkey"), ("max", "o_custkey"))


@query("SELECT count(st) AS n FROM (SELECT nullif(o_orderstatus, 'P') AS st FROM orders) t")
def agg_count_col(t: Tables) -> DataFrame:
    return aggregate(status(t), [], [("count", "st", "n")])


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag")
def agg_avg(t: Tables) -> DataFrame:
    return aggregate(t.lineitem, ["l_returnflag"], [("avg", "l_quantity", "a")]).select("l_returnflag", F.round("a", 6).alias("a"))


@query("SELECT st, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'P') AS st FROM orders) t GROUP BY st")
def agg_null_group(t: Tables) -> DataFrame:
    return aggregate(status(t), ["st"], [("count", "*", "n")])


# sorts and limits


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def sort_asc(t: Tables) -> DataFrame:
    return sort(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort_desc(t: Tables) -> DataFrame:
    return sort(t.customer.select("c_custkey", "c_acctbal"), ("c_acctbal", "desc"), "c_custkey")


@query("SELECT st, o_orderkey FROM (SELECT nullif(o_orderstatus, 'P') AS st, o_orderkey FROM orders) t ORDER BY st ASC NULLS LAST, o_orderkey DESC")
def sort_multi(t: Tables) -> DataFrame:
    return sort(status(t).select("st", "o_orderkey"), "st", ("o_orderkey", "desc"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
def limit_only(t: Tables) -> DataFrame:
    return limit(sort(t.orders.select("o_orderkey"), "o_orderkey"), 10)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
def limit_offset(t: Tables) -> DataFrame:
    return limit(sort(t.orders.select("o_orderkey"), "o_orderkey"), 10, 25)


@query("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 0) t")
def limit_zero(t: Tables) -> DataFrame:
    return counted(limit(t.orders.select("o_orderkey"), 0))


@query("SELECT count(*) AS n FROM (SELECT r_name FROM region ORDER BY r_name LIMIT 5 OFFSET 999) t")
def offset_past_end(t: Tables) -> DataFrame:
    return counted(limit(sort(t.region.select("r_name"), "r_name"), 5, 999))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5")
def topk(t: Tables) -> DataFrame:
    return limit(sort(aggregate(t.orders, ["o_custkey"], [("count", "*", "n")]), ("n", "desc"), "o_custkey"), 5)


# exchanges


@query("SELECT o_orderkey, o_custkey FROM orders")
def exchange_hash(t: Tables) -> DataFrame:
    return exchange.apply(t.orders.select("o_orderkey", "o_custkey"), '{"Hash": {"keys": ["o_custkey"]}}')


@query("SELECT c_custkey FROM customer")
def exchange_roundrobin(t: Tables) -> DataFrame:
    return exchange.apply(t.customer.select("c_custkey"), "round_robin")


@query("SELECT p_partkey, p_size FROM part")
def exchange_range(t: Tables) -> DataFrame:
    return exchange.apply(t.part.select("p_partkey", "p_size"), '{"Range": {"column": "p_size", "bounds": [10, 20, 30, 40]}}')


@query("SELECT s_suppkey, s_name FROM supplier")
def exchange_single(t: Tables) -> DataFrame:
    return exchange.apply(t.supplier.select("s_suppkey", "s_name"), "single")


@query("SELECT s_suppkey, s_name FROM supplier")
def exchange_broadcast(t: Tables) -> DataFrame:
    return exchange.apply(t.supplier.select("s_suppkey", "s_name"), "broadcast")


@query("SELECT o_orderkey, o_custkey FROM orders")
def exchange_spec(t: Tables) -> DataFrame:
    """Every way to write a partitioning, one after the other."""
    df = t.orders.select("o_orderkey", "o_custkey")
    for spec in ("round_robin_batch", '{"Hash": {"key_columns": ["o_custkey"]}}', '{"Range": {"key_column": "o_orderkey", "bounds": []}}', '{"Range": {"partition_key_column": "o_orderkey", "bounds": [100, 9]}}'):
        df = exchange.apply(df, spec)
    return df


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def exchange_roundtrip(t: Tables) -> DataFrame:
    """Rows dealt by key, kept as files and read again with their hashes verified."""
    path = t.folder("exchange")
    results.materialise(exchange.apply(t.customer.select("c_custkey", "c_name", "c_nationkey"), '{"Hash": {"keys": ["c_nationkey"]}}'), path)
    return results.load(t.spark, path, hashes=True)


# file skipping by kind of column


@query("SELECT o_orderkey, d FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) t WHERE d >= '1997-01-01' AND d < '1997-02-01'")
def scan_pruned_date(t: Tables) -> DataFrame:
    orders = dated(t)
    p = Compare("d", ">=", date(1997, 1, 1)) & Compare("d", "<", date(1997, 2, 1))
    return scan(t.spark, t.logged(orders, "d"), orders.schema, p)


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN '2024-01-10 00:00:00' AND '2024-01-11 00:00:00'")
def scan_pruned_timestamp(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "ts")
    return scan(t.spark, t.logged(events, "ts"), events.schema, Between("ts", datetime(2024, 1, 10), datetime(2024, 1, 11)))


@query("SELECT o_orderkey, CAST(p AS DECIMAL(15, 2)) AS p FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15, 2)) AS p FROM orders) t WHERE p < 2000.50")
def scan_pruned_decimal(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("p"))
    return scan(t.spark, t.logged(orders, "p"), orders.schema, typed(Compare("p", "<", Decimal("2000.50")), orders.schema))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal END AS b FROM customer WHERE c_custkey % 10 = 0 OR c_acctbal > 9000")
def scan_pruned_nan(t: Tables) -> DataFrame:
    """NaN ranks above all numbers, and files that hold one are never skipped for their greatest number."""
    customer = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("b"))
    return scan(t.spark, t.logged(customer, "c_custkey"), customer.schema, Compare("b", ">", 9000.0))


# the log


@query("SELECT r_regionkey, r_name FROM region")
def log_replay(t: Tables) -> DataFrame:
    """A commit for each row, read from all of them."""
    region = t.region.select("r_regionkey", "r_name")
    log = TableLog(t.folder("table"))
    log.create()
    for k in range(5):
        log.append(region.where(F.col("r_regionkey") % 5 == k))
    return scan(t.spark, TableLog(log.location), region.schema)


@query("SELECT n_nationkey, n_name FROM nation")
def commit_recovery(t: Tables) -> DataFrame:
    """A stage whose writer was lost is undone, a commit with a token is made once."""
    nation = t.nation.select("n_nationkey", "n_name")
    log = t.logged(nation, "n_nationkey")
    lost = log.stage(nation.limit(3))
    for _ in range(2):
        log.append(nation.limit(0), token=["stream", 1])
    assert log.recover(older=0) == {lost: "aborted"}
    return scan(t.spark, log, nation.schema)


@query("SELECT p_partkey, p_brand FROM part")
def object_store_roundtrip(t: Tables) -> DataFrame:
    """A logged table through Hadoop's file systems alone."""
    part = t.part.select("p_partkey", "p_brand")
    log = TableLog(t.folder("table"), Hadoop())
    log.create()
    log.append(part)
    return scan(t.spark, log, part.schema)


@query("""SELECT 'n_nationkey' AS name, CAST(min(n_nationkey) AS VARCHAR) AS low, CAST(max(n_nationkey) AS VARCHAR) AS high, CAST(0 AS BIGINT) AS nulls FROM nation
UNION ALL SELECT 'n_name', min(n_name), max(n_name), CAST(0 AS BIGINT) FROM nation UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR), CAST(count(*) AS VARCHAR), CAST(0 AS BIGINT) FROM nation""")
def table_statistics(t: Tables) -> DataFrame:
    held = t.logged(t.nation.select("n_nationkey", "n_name"), "n_nationkey").summary()
    rows = [(n, str(c["min"]), str(c["max"]), c["nulls"]) for n, c in held["columns"].items()]
    return t.spark.createDataFrame([*rows, ("rows", str(held["rows"]), str(held["rows"]), 0)], "name string, low string, high string, nulls long")


# statements, through an engine


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def append_roundtrip(t: Tables) -> DataFrame:
    engine = t.engine()
    assert engine.run("create table w.s.o (o_orderkey bigint not null, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp)").ok
    engine.append("w.s.o", t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"))
    return engine.table("w.s.o")


def _inserted(t: Tables) -> Engine:
    """An engine with region's rows, put in by an INSERT statement."""
    engine = t.engine()
    values = ", ".join(f"({r.r_regionkey}, '{r.r_name}')" for r in t.region.select("r_regionkey", "r_name").collect())  # five rows
    outcome = engine.run("create table w.s.region (r_regionkey bigint not null, r_name string)" + (f"; insert into w.s.region values {values}" if values else ""))
    assert outcome.ok, outcome
    return engine


@query("SELECT r_regionkey, r_name FROM region")
def insert_roundtrip(t: Tables) -> DataFrame:
    return _inserted(t).sql("select r_regionkey, r_name from w.s.region")


@query("SELECT r.r_name, count(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
def script_roundtrip(t: Tables) -> DataFrame:
    """A script's last outcome holds the rows of its query, over a logged table and a registered one."""
    engine = _inserted(t)
    engine.register("nation", engine.spark.read.parquet(f"{t.sf_dir}/nation.parquet"))
    return engine.run("use warehouse big; -- a comment; with a semicolon\nselect r.r_name, count(*) as n from nation n join w.s.region r on n.n_regionkey = r.r_regionkey group by r.r_name").rows


@query("SELECT r_regionkey, r_name FROM region")
def ingest_roundtrip(t: Tables) -> DataFrame:
    from millrace.streaming.ingest import ingest

    engine = t.engine()
    assert engine.run("create table w.s.r (r_regionkey bigint not null, r_name string)").ok
    ingest(engine, "w.s.r", t.region.select("r_regionkey", "r_name").toArrow().to_batches())
    return engine.table("w.s.r")


@query("SELECT n_nationkey, n_name FROM nation")
def stream_roundtrip(t: Tables) -> DataFrame:
    """A stream's micro-batches as commits, each once."""
    from millrace.streaming.ingest import stream_into

    engine, source = t.engine(), t.folder("source")
    assert engine.run("create table w.s.n (n_nationkey bigint not null, n_name string)").ok
    t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").repartition(2).write.parquet(source)
    stream = engine.spark.readStream.schema("n_nationkey long, n_name string").option("maxFilesPerTrigger", 1).parquet(source)
    stream_into(engine, "w.s.n", stream, t.folder("stream")).awaitTermination(120)
    return engine.table("w.s.n")


@query("SELECT r_regionkey, r_name FROM region")
def result_retrieval(t: Tables) -> DataFrame:
    """A kept result, fetched by its handle as a stream of Arrow batches."""
    engine = _inserted(t)
    handle = engine.query("select r_regionkey, r_name from w.s.region")
    return t.spark.createDataFrame(pa.Table.from_batches(engine.batches(handle)))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 25 AND p_type IN ('ECONOMY', 'STANDARD') AND p_brand != 'Brand#1'")
def filter_transport(t: Tables) -> DataFrame:
    """A predicate sent as JSON."""
    p = Between("p_size", 5, 25) & In("p_type", ("ECONOMY", "STANDARD")) & Compare("p_brand", "!=", "Brand#1")
    return where(t.part, from_json(json.loads(json.dumps(p.to_json())))).select("p_partkey")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT) FROM region ORDER BY k")
def sort_mixed_types(t: Tables) -> DataFrame:
    """Batches of several integer types, brought to one and sorted."""
    return sort(t.nation.select(F.col("n_nationkey").cast("short").alias("k")).union(t.region.select(F.col("r_regionkey").cast("long"))), "k")


@query("SELECT 'w.s.region' AS name, count(*) AS n, CAST(1 AS BIGINT) AS version FROM region")
def dashboard_tables(t: Tables) -> DataFrame:
    held = _inserted(t).dashboard()["tables"]
    return t.spark.createDataFrame([(k, v["rows"], v["version"]) for k, v in held.items()], "name string, n long, version long")


def _codes(name: str, cases: dict[str, str], run: Callable[[Engine, str], str]) -> None:
    """A query of (statement, code): what an engine answers to each statement, in order."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    ORACLES[name] = "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in cases.items()) + ") t(statement, code)"

    def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _inserted(Tables(spark, sf_dir))
        return spark.createDataFrame([(k, run(engine, k)) for k in cases], "statement string, code string")

    QUERIES[name] = answers


def _code(engine: Engine, statement: str) -> str:
    out = engine.run(statement)
    return out.code if out.ok else out.error_code


def _gate(engine: Engine, text: str) -> str:
    column, op, value = text.split(" ", 2)
    try:
        typed(Compare(column, op, literal(value)), engine.catalog.schema("w.s.region"))
    except ValidationError as error:
        return error.code
    return "OK"


_codes("catalog_statements", {
    "create database w": "VALIDATION_DATABASE_ALREADY_EXISTS", "create database if not exists w": "DATABASE_ALREADY_EXISTS_SKIPPED", "create schema nope.s": "VALIDATION_DATABASE_NOT_FOUND",
    "create schema w.t": "SCHEMA_CREATED", "create table w.t.a (id int, price decimal(10,2))": "TABLE_CREATED", "create table w.t.b (id map)": "VALIDATION_INVALID_DATATYPE_CONTRACT",
    "create table a (id int)": "VALIDATION_INVALID_TABLE_NAMESPACE", "drop schema w.t": "VALIDATION_SCHEMA_NOT_EMPTY", "drop table w.t.a": "TABLE_DROPPED", "drop table w.t.a ": "VALIDATION_TABLE_NOT_FOUND",
    "drop table if exists w.t.a": "TABLE_NOT_FOUND_SKIPPED", "drop schema w.t ": "SCHEMA_DROPPED", "use warehouse big": "WAREHOUSE_SET", "update w.s.region set r_name = 'x'": "VALIDATION_UNSUPPORTED_STATEMENT",
}, _code)
_codes("insert_validations", {
    "insert into w.s.region (r_name) values ('x')": "CONSTRAINT_NOT_NULL_COLUMNS_MISSING", "insert into w.s.region values (null, 'x')": "CONSTRAINT_NOT_NULL_VIOLATION",
    "insert into w.s.region values (1.5, 'x')": "VALIDATION_INSERT_TYPE_MISMATCH", "insert into w.s.region values (1)": "VALIDATION_INSERT_ROW_WIDTH", "insert into w.s.nope values (1)": "VALIDATION_TABLE_NOT_FOUND",
    "create table w.s.m (price decimal(6,2), dt datetime)": "TABLE_CREATED", "insert into w.s.m values (1.234, null)": "VALIDATION_DECIMAL_COERCION_FAILED",
    "insert into w.s.m values (1.23, '2024-01-01T00:00:00Z')": "VALIDATION_DATETIME_TIMEZONE_NOT_ALLOWED", "insert into w.s.m values (1.23, '2024-01-01 00:00:00')": "INSERT_DISPATCHED",
}, _code)
_codes("role_statements", {
    "create user ann": "RBAC_COMMAND_APPLIED", "create role reader": "RBAC_COMMAND_APPLIED", "grant role reader to user ann": "RBAC_COMMAND_APPLIED", "grant role nope to user ann": "VALIDATION_RBAC_COMMAND_REJECTED",
    "grant role reader ann": "VALIDATION_INVALID_RBAC_COMMAND", "create group g": "RBAC_COMMAND_APPLIED", "delete group g": "RBAC_COMMAND_APPLIED", "drop role reader": "RBAC_COMMAND_APPLIED", "delete user ann": "RBAC_COMMAND_APPLIED",
}, _code)
_codes("filter_type_gate", {
    "r_regionkey = 1": "OK", "r_regionkey = 'x'": "VALIDATION_UNSUPPORTED_PREDICATE", "r_name = 1": "VALIDATION_UNSUPPORTED_PREDICATE", "r_name = 'x'": "OK", "nope = 1": "VALIDATION_UNSUPPORTED_PREDICATE", "r_regionkey > 1.5": "OK",
}, _gate)


def _asked_as(engine: Engine, case: str) -> str:
    """What a user in a role, after some scopes, gets for a SELECT of both tables."""
    user, role, *scopes = case.split()
    engine.run(f"create user {user}; ")
    engine.run(f"create role {role}")
    if scopes and scopes[0] != "ungranted":
        engine.run(f"grant role {role} to user {user}")
        engine.rbac.allow(role, *scopes)
    other = Engine(engine.spark, engine.root, session=Session(user, role.upper()))
    return _code(other, "select a.r_name from w.s.region a join w.s.region b on a.r_regionkey = b.r_regionkey")


_codes("select_authorisation", {
    "ann reader select:w.s.region": "QUERY_DISPATCHED", "bob other select:w.s.nope": "VALIDATION_AUTHORIZATION_DENIED", "cid all select:*.*.*": "QUERY_DISPATCHED", "dan stolen ungranted": "VALIDATION_AUTHORIZATION_DENIED", "eve schema select:w.s.*": "QUERY_DISPATCHED",
}, _asked_as)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by market segment, largest first: a join, an aggregate and a top-k."""
    t = Tables(spark, sf_dir)
    rows = aggregate(orders_customers(t), ["c_mktsegment"], [("count", "*", "n"), ("sum", "o_totalprice", "total")])
    return limit(sort(rows, ("n", "desc"), "c_mktsegment"), 10)
