import os
from datetime import datetime
from decimal import Decimal

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace import commands, results
from millrace.catalog import qualified
from millrace.functions.declared import Column, exact_decimal, literal, spark_type
from millrace.operators import exchange
from millrace.operators.predicates import And, Between, Compare, In, IsNotNull, IsNull, from_json, typed
from millrace.operators.relational import aggregate, join, limit, sort
from millrace.outcomes import ConstraintError, Outcome, ValidationError, WarehouseError
from millrace.plans import capability
from millrace.plans.explain import pushed_filters, stages
from millrace.session import Engine, Session
from millrace.sources.scan import may_match
from millrace.sources.tablelog import File
from millrace.streaming.ingest import ingest, stream_into
from millrace.telemetry import measured

SCRIPT = """
create database abc; create schema abc.schema1; -- two; statements
create table abc.schema1.table1 (id int not null, name string, price decimal(10,2), at timestamp, dt datetime, ok boolean);
insert into abc.schema1.table1 values (1, 'a;b', 1.50, '2024-01-01T02:00:00+02:00', '2024-01-01 10:00:00', true), (2, null, 2.25, 1704153600000, null, false);
insert into abc.schema1.table1 (id, name) values (3, 'it''s');
create table abc.schema1.table2 (id int, document string);
insert into abc.schema1.table2 values (1, 'x'), (1, 'y'), (9, 'z');
"""


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    out = e.run(SCRIPT)
    assert out.code == "INSERT_DISPATCHED", out
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_insert_and_select(engine):
    got = rows(engine.sql("select id, name, price, at, dt, ok from abc.schema1.table1 order by id"))
    assert got[0] == (1, "a;b", Decimal("1.50"), datetime(2024, 1, 1), datetime(2024, 1, 1, 10), True)
    assert got[1][3] == datetime(2024, 1, 2) and got[2] == (3, "it's", None, None, None, None)


def test_nulls_last_both_ways(engine):
    assert rows(engine.sql("select name from abc.schema1.table1 order by name"))[-1] == (None,)
    assert rows(engine.sql("select name from abc.schema1.table1 order by name desc"))[-1] == (None,)
    assert commands.nulls_last("select a from t order by a, f(b, c) desc nulls first limit 3").split("order by")[1].split() == "a NULLS LAST, f(b, c) desc nulls first limit 3".split()


def test_join_and_names(engine):
    got = engine.sql("select * from abc.schema1.table1 t join abc.schema1.table2 u on t.id = u.id")
    assert got.columns[-2:] == ["table2_id", "document"] and got.count() == 2
    got = engine.sql("select count(*), sum(id), max(u.id) from abc.schema1.table2 u")
    assert got.columns == ["count", "sum_id", "max_id"] and rows(got) == [(3, 11, 9)]
    assert rows(engine.sql("select abc.schema1.table2.document from abc.schema1.table2 where abc.schema1.table2.id = 9")) == [("z",)]


@pytest.mark.parametrize(("sql", "code"), [
    ("insert into abc.schema1.table1 (name) values ('x')", "CONSTRAINT_NOT_NULL_COLUMNS_MISSING"),
    ("insert into abc.schema1.table1 (id) values (null)", "CONSTRAINT_NOT_NULL_VIOLATION"),
    ("insert into abc.schema1.table1 (id, price) values (1, 12.345)", "VALIDATION_DECIMAL_COERCION_FAILED"),
    ("insert into abc.schema1.table1 (id, dt) values (1, '2024-01-01T00:00:00Z')", "VALIDATION_DATETIME_TIMEZONE_NOT_ALLOWED"),
    ("insert into abc.schema1.table1 (id, at) values (1, 'soon')", "VALIDATION_TEMPORAL_LITERAL_INVALID"),
    ("insert into abc.schema1.nothere values (1)", "VALIDATION_TABLE_NOT_FOUND"),
    ("create table abc.schema1.t (a array)", "VALIDATION_INVALID_DATATYPE_CONTRACT"),
    ("create table abc.nope.t (a int)", "VALIDATION_SCHEMA_NOT_FOUND"),
    ("create table t (a int)", "VALIDATION_INVALID_TABLE_NAMESPACE"),
    ("create database abc", "VALIDATION_DATABASE_ALREADY_EXISTS"),
    ("delete from abc.schema1.table1", "VALIDATION_UNSUPPORTED_STATEMENT"),
])
def test_failures_write_nothing(engine, sql, code):
    before = engine.table("abc.schema1.table1").count()
    out = engine.run(sql)
    assert (out.status, out.error_code) == ("ERROR", code)
    assert engine.table("abc.schema1.table1").count() == before


def test_if_not_exists_and_use_warehouse(engine):
    assert engine.run("create database if not exists abc").code == "DATABASE_ALREADY_EXISTS_SKIPPED"
    assert engine.run("use warehouse big").ok and engine.session.warehouse == "big"


def test_snapshot_and_file_skipping(engine):
    name = "abc.schema1.table2"
    log = engine.log(name)
    assert log.versions() == [0, 1] and engine.table(name, version=0).count() == 0
    engine.run(f"insert into {name} values (100, 'far')")
    assert engine.table(name, version=1).count() == 3
    assert rows(engine.table(name, Compare("id", ">", 50))) == [(100, "far")]
    assert len(engine.table(name, Compare("id", ">", 50)).inputFiles()) == 1
    assert engine.table(name, Compare("id", ">", 500)).count() == 0
    assert log.summary()["columns"]["id"] == {"min": 1, "max": 100, "nulls": 0}


def test_append_checks_not_null(engine):
    df = engine.spark.createDataFrame([(None, "x")], "id int, name string")
    with pytest.raises(ConstraintError) as e:
        engine.append("abc.schema1.table1", df)
    assert e.value.code == "CONSTRAINT_NOT_NULL_VIOLATION"
    engine.append("abc.schema1.table1", engine.spark.createDataFrame([(7, "x")], "id int, name string"))
    assert engine.table("abc.schema1.table1", Compare("id", "=", 7)).count() == 1


def test_results_are_verified(engine):
    handle = engine.query("select id from abc.schema1.table2")
    assert engine.fetch(handle).count() == 3
    part = next(f for f in os.listdir(handle) if f.endswith(".parquet"))
    with open(os.path.join(handle, part), "ab") as f:
        f.write(b"x")
    with pytest.raises(WarehouseError, match="parquet"):
        results.load(engine.spark, handle)


def test_roles(engine, spark):
    for c in ("create user ann", "create role reader", "grant role reader to user ann"):
        assert engine.run(c).code == "RBAC_COMMAND_APPLIED"
    assert engine.run("create role reader").error_code == "VALIDATION_RBAC_COMMAND_REJECTED"
    assert engine.run("grant role reader ann").error_code == "VALIDATION_INVALID_RBAC_COMMAND"
    engine.rbac.allow("reader", "select:abc.schema1.table2")
    other = Engine(spark, engine.root, session=Session("ann", "READER"))
    assert other.sql("select id from abc.schema1.table2").count() == 3
    with pytest.raises(ValidationError):
        other.sql("select t.id from abc.schema1.table2 t join abc.schema1.table1 u on t.id = u.id")


STRICT_OK = [
    "select id, name from abc.schema1.table1 where id between 1 and 2 and name != 'x' order by id limit 2 offset 1",
    "select count(*) as n, name from abc.schema1.table1 where id in (1, 2) and name is not null group by name",
    "select t.id from abc.schema1.table1 t join abc.schema1.table2 u on t.id = u.id",
    "select * from abc.schema1.table1 where id not between 2 and 3",
]
STRICT_BAD = [
    ("select id from abc.schema1.table1 union select id from abc.schema1.table2", "VALIDATION_UNSUPPORTED_QUERY_SHAPE"),
    ("select id from (select id from abc.schema1.table1) x", "VALIDATION_UNSUPPORTED_QUERY_SHAPE"),
    ("select t.id from abc.schema1.table1 t left join abc.schema1.table2 u on t.id = u.id", "VALIDATION_UNSUPPORTED_QUERY_SHAPE"),
    ("select t.id from abc.schema1.table1 t join abc.schema1.table2 u on t.id > u.id", "VALIDATION_UNSUPPORTED_QUERY_SHAPE"),
    ("select id from abc.schema1.table1 where id = 1 or id = 2", "VALIDATION_UNSUPPORTED_PREDICATE"),
    ("select id from abc.schema1.table1 where name like 'a%'", "VALIDATION_UNSUPPORTED_PREDICATE"),
    ("select id from abc.schema1.table1 where id = 1.5", "VALIDATION_UNSUPPORTED_PREDICATE"),
    ("select id from abc.schema1.table1 where id not in (1)", "VALIDATION_UNSUPPORTED_PREDICATE"),
    ("select distinct id from abc.schema1.table1", "VALIDATION_UNSUPPORTED_QUERY_SHAPE"),
    ("select id + 1 from abc.schema1.table1", "VALIDATION_UNSUPPORTED_OPERATOR"),
    ("select name from abc.schema1.table1 group by name", "VALIDATION_UNSUPPORTED_PIPELINE"),
    ("select count(*) c, name from abc.schema1.table1 group by name having count(*) > 1", "VALIDATION_UNSUPPORTED_QUERY_SHAPE"),
    ("select id from abc.schema1.table1 offset 2", "VALIDATION_UNSUPPORTED_QUERY_SHAPE"),
    ("select row_number() over (order by id) from abc.schema1.table1", "VALIDATION_UNSUPPORTED_PREDICATE"),
]


@pytest.mark.parametrize("sql", STRICT_OK)
def test_strict_accepts(spark, sql):
    capability.check(spark, sql)


@pytest.mark.parametrize(("sql", "code"), STRICT_BAD)
def test_strict_rejects(spark, sql, code):
    with pytest.raises(ValidationError) as e:
        capability.check(spark, sql)
    assert e.value.code == code


def test_default_mode_offers_all_of_spark(engine):
    assert engine.sql("with x as (select id from abc.schema1.table1) select id from x union all select id from abc.schema1.table2").count() == 6
    assert engine.sql("select name, row_number() over (order by id) r from abc.schema1.table1 where id = 1 or name like 'i%'").count() == 2


def test_joins(spark):
    left = spark.createDataFrame([(1, "L1"), (2, "L2"), (1, "L3"), (None, "L4")], "id long, name string")
    right = spark.createDataFrame([(1, "R1"), (1, "R2"), (3, "R3"), (None, "R4")], "id long, value string")
    both = join(left, right, [("id", "id")], "orders")
    assert both.columns == ["id", "name", "orders_id", "value"] and both.count() == 4
    assert join(left, right, [("id", "id")], "orders", null_safe=True).count() == 5
    assert join(left, right.where("id = 3"), [("id", "id")], "o").count() == 0
    with pytest.raises(ValidationError):
        join(left, right, [])


def test_aggregates(spark):
    df = spark.createDataFrame([("br", 10), ("br", None), ("us", None), ("us", 7), (None, None)], "country string, amount long")
    got = {r.country: tuple(r)[1:] for r in aggregate(df, ["country"], [("count", "amount"), ("sum", "amount"), ("avg", "amount")]).collect()}
    assert got == {"br": (1, 10, 10.0), "us": (1, 7, 7.0), None: (0, None, None)}
    got = {r.country: r.sum_amount for r in aggregate(df, ["country"], [("sum", "amount")], compat=True).collect()}
    assert got == {"br": 10.0, "us": 7.0, "<NULL>": 0.0}
    empty = df.limit(0)
    assert rows(aggregate(empty, [], [("count", "*")])) == [(0,)] and rows(aggregate(empty, [], [("count", "*")], compat=True)) == []
    with pytest.raises(ValidationError):
        aggregate(df, [], [("median", "amount")])


def test_sort_and_limit(spark):
    df = spark.createDataFrame([(i,) for i in (3, None, 1, 2)], "k int")
    assert [r.k for r in sort(df, ("k", "desc")).collect()] == [3, 2, 1, None]
    assert [r.k for r in limit(sort(df, "k"), 2, 1).collect()] == [2, 3]
    assert limit(df, 0).count() == 0 and limit(df, 5, 99).count() == 0


def test_exchanges_keep_all_rows(spark):
    df = spark.range(1000).selectExpr("id as k", "id % 7 as g")
    for spec in ("single", "broadcast", "round_robin", '{"Hash": {"keys": ["g"]}}', '{"Range": {"column": "k", "bounds": [100, 500]}}'):
        assert sorted(r.k for r in exchange.apply(df, spec, 5).collect()) == list(range(1000))
    assert exchange.apply(df, '{"Hash": {"keys": ["g"]}}', 5).rdd.getNumPartitions() == 5
    ranged = exchange.apply(df, '{"Range": {"column": "k", "bounds": [100, 500]}}')
    assert sorted(len(p) for p in ranged.rdd.glom().collect() if p) == [100, 400, 500]
    for bad in ("what", '{"Hash": {}}', '{"Range": {"column": "k"}}'):
        with pytest.raises(ValidationError):
            exchange.parse(bad)


def test_plans(engine, spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where(Compare("o_orderkey", ">", 5).column_expression()).select("o_orderkey")
    assert "GreaterThan(o_orderkey,5)" in pushed_filters(df)[0]
    assert any("Scan" in s or "FileScan" in s for s in stages(df.groupBy().count()))
    with measured(spark, "count") as report:
        df.count()
    assert report.seconds > 0 and report.stages


def test_ingest_limits(engine):
    batch = pa.RecordBatch.from_pydict({"id": pa.array([5, 6], pa.int32()), "document": ["p", "q"]})
    ingest(engine, "abc.schema1.table2", [batch])
    assert engine.table("abc.schema1.table2").count() == 5
    with pytest.raises(ValidationError):
        ingest(engine, "abc.schema1.table2", [batch] * 129)
    assert engine.table("abc.schema1.table2").count() == 5


def test_stream_into_table(engine, tmp_path):
    engine.spark.createDataFrame([(21, "s"), (22, "t")], "id int, document string").write.parquet(str(tmp_path / "in"))
    stream = engine.spark.readStream.schema("id int, document string").parquet(str(tmp_path / "in"))
    stream_into(engine, "abc.schema1.table2", stream, str(tmp_path / "check")).awaitTermination(60)
    assert engine.table("abc.schema1.table2", Compare("id", ">", 20)).count() == 2


def test_outcome_envelope():
    assert Outcome.of_envelope("RESULT|VALIDATION|VALIDATION_X|m|n").error_code == "VALIDATION_X"
    assert Outcome.of_envelope("RESULT|SUCCESS|A|b").status == "OK"
    assert Outcome.of_envelope("boom").error_code == "INFRA_GENERIC"


def test_names_and_types():
    assert qualified('"DB".S.`T-1`') == ("db", "s", "t-1") and qualified("t") == ("default", "public", "t")
    for bad in ("interval", "decimal", "decimal(40,2)", "map<int,int>", "int(3)"):
        with pytest.raises(ValidationError):
            spark_type(bad)
    assert literal(-128, Column("a", "tinyint")) == -128
    with pytest.raises(ValidationError):
        literal(128, Column("a", "tinyint"))


scalars = st.integers(-1000, 1000)
leaf = st.one_of(
    st.builds(Compare, st.just("k"), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), scalars),
    st.builds(Between, st.just("k"), scalars, scalars, st.booleans()),
    st.builds(lambda v: In("k", tuple(v)), st.lists(scalars, min_size=1, max_size=4)),
    st.just(IsNull("k")), st.just(IsNotNull("k")),
)


@settings(max_examples=60, deadline=None)
@given(st.lists(leaf, min_size=1, max_size=4).map(lambda x: And(tuple(x))), st.lists(st.one_of(st.none(), scalars), min_size=1, max_size=6))
def test_skipping_never_loses_a_row(p, values):
    def holds(x, v):
        if isinstance(x, And):
            return all(holds(y, v) for y in x.parts)
        if isinstance(x, IsNull):
            return v is None
        if v is None:
            return False
        if isinstance(x, IsNotNull):
            return True
        if isinstance(x, Between):
            return (x.low <= v <= x.high) != x.negated
        if isinstance(x, In):
            return v in x.values
        return {"=": v == x.value, "!=": v != x.value, "<": v < x.value, "<=": v <= x.value, ">": v > x.value, ">=": v >= x.value}[x.op]

    known = [v for v in values if v is not None]
    file = File("f", len(values), 1, {"k": min(known)} if known else {}, {"k": max(known)} if known else {}, {"k": len(values) - len(known)})
    assert from_json(p.to_json()) == p
    if any(holds(p, v) for v in values):
        assert may_match(file, p)


@given(st.decimals(allow_nan=False, allow_infinity=False, min_value=-(10**6), max_value=10**6, places=3))
def test_decimals_are_exact_or_refused(d):
    fits = d == d.quantize(Decimal("0.01")) and abs(d) < 10**6
    try:
        assert exact_decimal(format(d, "f"), 8, 2) == d and fits
    except ValidationError:
        assert not fits


def test_type_gate(spark):
    schema = spark.createDataFrame([], "id int, name string, at timestamp_ntz").schema
    for bad in (Compare("id", "=", "x"), Compare("name", "=", 1), Compare("at", ">", 5), Compare("at", ">", "soon"), Compare("zz", "=", 1)):
        with pytest.raises(ValidationError):
            typed(bad, schema)
    assert typed(Compare("at", ">", "2024-01-01 00:00:00"), schema).value == datetime(2024, 1, 1)
