"""The log, the catalog, skipping, results and roles where things go wrong: odd values, lost writers, two engines."""

import json
import math
import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace import __main__ as cli
from millrace import queries, results
from millrace.operators.predicates import And, Between, Compare, In, IsNotNull, from_json, typed
from millrace.outcomes import ValidationError, WarehouseError
from millrace.session import Engine, Session
from millrace.sources import tablelog
from millrace.sources.files import Hadoop, Mounted
from millrace.sources.ledger import Ledger
from millrace.sources.scan import judge, may_match, scan
from millrace.sources.tablelog import File, TableLog


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"))
    assert e.run("create database a; create schema a.s; create table a.s.t (id int not null, v double, d date, at timestamp, p decimal(10,2), n string)").ok
    return e


KINDS = {
    "double": (st.one_of(st.floats(-5, 5, width=16), st.sampled_from([float("nan"), float("inf"), -float("inf"), 0.0, -0.0])), float),
    "date": (st.dates(date(2024, 1, 1), date(2024, 1, 9)), date),
    "timestamp_ntz": (st.datetimes(datetime(2024, 1, 1), datetime(2024, 1, 2), allow_imaginary=True).map(lambda v: v.replace(fold=0)), datetime),
    "decimal(6,2)": (st.decimals(-9, 9, places=2), Decimal),
    "string": (st.text("abZé", max_size=3), str),
}


def rank(v):
    """Spark's order: NaN above all and equal to itself."""
    return (1, 0.0) if isinstance(v, float) and math.isnan(v) else (0, v)


@pytest.mark.parametrize("kind", KINDS)
def test_skipping_never_loses_a_row(kind):
    values = KINDS[kind][0]
    leaf = st.one_of(st.builds(Compare, st.just("k"), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), values), st.builds(Between, st.just("k"), values, values, st.booleans()))

    def holds(p, v):
        if v is None:
            return False
        if isinstance(p, Between):
            return (rank(p.low) <= rank(v) <= rank(p.high)) != p.negated
        a, b = rank(v), rank(p.value)
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[p.op]

    @settings(max_examples=150, deadline=None)
    @given(st.lists(leaf, min_size=1, max_size=3), st.lists(st.one_of(st.none(), values), max_size=5), st.booleans())
    def check(ps, rows, counted):
        known = [v for v in rows if v is not None]
        plain = [v for v in known if not (isinstance(v, float) and math.isnan(v))]
        if not counted and len(plain) < len(known):
            return  # bounds without a count of NaNs are made by other writers, from files that may hold none
        nans = {"k": len(known) - len(plain)} if kind == "double" and counted else {}
        file = File("f", len(rows), 1, {"k": min(plain)} if plain else {}, {"k": max(plain)} if plain else {}, {"k": len(rows) - len(known)}, nans)
        p = And(tuple(ps))
        assert repr(from_json(json.loads(json.dumps(p.to_json())))) == repr(p)
        if any(all(holds(x, v) for x in ps) for v in rows):
            assert may_match(file, p), (p, file)

    check()


def test_files_are_skipped_by_every_kind_of_bound(engine):
    engine.spark.conf.set("spark.sql.shuffle.partitions", "2")
    for k in range(3):
        rows = [(10 * k + i, float(k) if i else float("nan") if k == 0 else 0.5, date(2024, 1, 1 + k), datetime(2024, 1, 1 + k, i), Decimal(k) + Decimal("0.25"), "abc"[k]) for i in range(3)]
        engine.append("a.s.t", engine.spark.createDataFrame(rows, "id int, v double, d date, at timestamp_ntz, p decimal(10,2), n string").coalesce(1))
    for p, files, n in (
        (Compare("id", ">=", 20), 1, 3), (Compare("d", "=", "2024-01-02"), 1, 3), (Compare("at", "<", "2024-01-01 01:00:00"), 1, 1), (Compare("p", ">", Decimal("2.0")), 1, 3), (Compare("p", "<=", 0.25), 1, 3),
        (Between("n", "b", "b"), 1, 3), (In("d", (date(2024, 1, 3),)), 1, 3), (Compare("v", ">", 100.0), 1, 1), (Compare("v", "=", 2.0), 1, 2), (Compare("v", "!=", 0.0), 3, 7), (IsNotNull("n"), 3, 9), (Compare("id", ">", 99), 0, 0),
    ):
        df = engine.table("a.s.t", p)
        assert (df.pruning.kept, df.count()) == (files, n), p
        assert df.count() == engine.table("a.s.t").where(typed(p, df.schema).column_expression()).count()
    assert engine.events[-1]["event"] == "scan" and engine.events[-1]["files"] == 3 and "skipped:bounds" in df.pruning.reasons
    assert judge(File("f", 1, 1, {"k": 1}, {"k": 2}, {"k": 0}), Compare("k", "=", "x")) == (True, "kinds_differ")
    assert judge(File("f", 1, 1), Compare("k", "=", 1)) == (True, "bounds_unknown")


def test_nan_as_written_by_spark(spark, tmp_path):
    rows = [(float("nan"),), (1.0,), (7.0,)]
    log = TableLog(str(tmp_path / "t"))
    log.create()
    for part in ([(1.0,), (float("nan"),)], rows):
        log.append(spark.createDataFrame(part, "v double").coalesce(1))
    schema = spark.createDataFrame(rows, "v double").schema
    for p, n in ((Compare("v", "=", 1.0), 2), (Compare("v", ">", 0.5), 5), (Compare("v", ">", 5.0), 3), (Compare("v", ">", 99.0), 2), (Compare("v", "<", 1.0), 0)):
        assert scan(spark, log, schema, p).count() == n, p


@pytest.mark.parametrize(("column", "kind", "bad", "good"), [
    ("id", "double", 2.7, 2.0), ("id", "long", 2**40, 5), ("id", "string", "x", "7"), ("p", "double", 1.239, 1.25), ("p", "decimal(12,3)", Decimal("1.239"), Decimal("1.230")),
    ("p", "int", 10**9, 3), ("d", "timestamp_ntz", datetime(2024, 1, 1, 3), datetime(2024, 1, 1)), ("v", "long", 2**53 + 1, 2**53),
])
def test_append_is_lossless_or_refused(engine, column, kind, bad, good):
    for value, fits in ((bad, False), (good, True)):
        df = engine.spark.createDataFrame([(1, value)] if column != "id" else [(value,)], f"id int, {column} {kind}" if column != "id" else f"id {kind}")
        if fits:
            engine.append("a.s.t", df)
        else:
            with pytest.raises(ValidationError) as e:
                engine.append("a.s.t", df)
            assert e.value.code == ("VALIDATION_DECIMAL_COERCION_FAILED" if column == "p" else "VALIDATION_INSERT_TYPE_MISMATCH")
    assert engine.table("a.s.t").count() == 1


def test_literals_and_comments_stay(engine):
    engine.run("insert into a.s.t (id, n) values (1, 'x')")
    sql = "select 'from a.s.t x' as q, a.s.t.n, 'a.s.t.n' as r /* from a.s.t */ from a.s.t -- join a.s.t\n where a.s.t.id = 1"
    assert [tuple(r) for r in engine.sql(sql).collect()] == [("from a.s.t x", "x", "a.s.t.n")]


def test_two_engines_lose_nothing(spark, tmp_path):
    one, two = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    assert one.run("create database a; create schema a.s").ok and two.run("create database b").ok and one.run("create database c").ok
    assert set(one.catalog.held["databases"]) == set(two.catalog.held["databases"]) == {"a", "b", "c"}
    assert one.run("create user u").ok and two.run("create user v").ok and set(one.rbac.held["user"]) == {"u", "v"}
    assert one.run("create table a.s.t (id int)").ok and two.run("insert into a.s.t values (1)").ok
    assert one.table("a.s.t").count() == 1 and two.run("drop table a.s.t").code == "TABLE_DROPPED" and one.catalog.tables() == []
    assert two.run("create table a.s.t (x string)").ok and one.table("a.s.t").columns == ["x"] and one.table("a.s.t").count() == 0
    ledger = Ledger(str(tmp_path / "l"), {"n": 0})
    other = Ledger(str(tmp_path / "l"), {"n": 0})
    for _ in range(12):
        ledger.update(lambda s: s.update(n=s["n"] + 1))
        other.update(lambda s: s.update(n=s["n"] + 1))
    assert ledger.read() == {"n": 24} and len(os.listdir(tmp_path / "l")) <= 9


def test_lost_writers_and_checkpoints(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tablelog, "CHECKPOINT", 3)
    log = TableLog(str(tmp_path / "t"))
    assert log.create() and not log.create()
    df = spark.range(3).coalesce(1)
    lost = log.stage(df)
    logged = log.stage(df)
    monkeypatch.setattr(log.store, "remove", lambda path: None)
    log.commit(logged, df.schema)  # its writer is lost before the manifest goes
    monkeypatch.undo()
    monkeypatch.setattr(tablelog, "CHECKPOINT", 3)
    assert log.recover() == {} and log.recover(0) == {lost: "aborted", logged: "committed"} and log.recover(0) == {}
    for k in range(6):
        assert log.append(df, ["s", k % 5]) == min(2 + k, 6)
    assert log.has(["s", 4]) and not log.has(["s", 9])
    assert [n for n in os.listdir(tmp_path / "t" / "_log") if n.endswith("checkpoint")]
    os.unlink(tmp_path / "t" / "_log" / f"{2:020d}.json")  # summed up by the checkpoint
    assert TableLog(log.location).summary()["rows"] == 18 and len(log.files(4)) == 4
    assert scan(spark, log, df.schema).count() == 18


def test_any_hadoop_file_system(spark, tmp_path):
    """The same warehouse through a file system that only Spark reads."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.m.link./w", f"file://{tmp_path}")
    engine = Engine(spark, "viewfs://m/w/root")
    assert isinstance(engine.catalog.ledger.store, Hadoop)
    assert engine.run("create database a; create schema a.s; create table a.s.t (id int not null); insert into a.s.t values (1), (2)").ok
    assert engine.sql("select sum(id) as n from a.s.t").first().n == 3
    handle = engine.query("select id from a.s.t")
    assert engine.fetch(handle, verify=True).count() == 2 and sum(b.num_rows for b in engine.batches(handle)) == 2
    other = Engine(spark, f"{tmp_path}/root")  # the same files, mounted
    assert isinstance(other.catalog.ledger.store, Mounted) and other.catalog.tables() == ["a.s.t"]
    assert engine.run("drop table a.s.t").ok and other.catalog.tables() == []
    log = TableLog("viewfs://m/w/log")
    assert log.create() and not log.create()


def test_results_have_owners_and_hashes(engine, spark):
    engine.run("insert into a.s.t (id) values (1), (2); create user ann; create role reader; grant role reader to user ann")
    engine.rbac.allow("reader", "select:a.s.t")
    handle = engine.query("select id from a.s.t")
    ann = Engine(spark, engine.root, session=Session("ann", "READER"))
    with pytest.raises(ValidationError):
        ann.fetch(handle)
    own = ann.query("select id from a.s.t")
    assert sum(b.num_rows for b in ann.batches(own)) == 2 and engine.fetch(own).count() == 2  # ADMIN may
    assert Engine(spark, engine.root, session=Session("ann", "READER")).fetch(own).count() == 2
    for wrong in (Session("ann", "ADMIN"), Session("bob", "READER")):
        with pytest.raises(ValidationError):
            Engine(spark, engine.root, session=wrong).sql("select id from a.s.t")
    assert ann.run("create user eve").error_code == "VALIDATION_AUTHORIZATION_DENIED"
    with pytest.raises(WarehouseError, match="no result"):
        engine.fetch(handle + "x")
    part = next(f for f in os.listdir(handle) if f.endswith(".parquet"))
    for name, change in (("rows", lambda a: a["rows"] + 1), ("checksum", lambda a: "5")):
        meta = results.metadata(handle)
        meta["artifacts"][0][name] = change(meta["artifacts"][0])
        path = os.path.join(handle, results.META)
        was = open(path).read()  # noqa: SIM115
        with open(path, "w") as f:
            json.dump(meta, f)
        assert engine.fetch(handle).count() == 2
        with pytest.raises(WarehouseError) as e:
            engine.fetch(handle, verify=True)
        assert e.value.code == "EXECUTION_RESULT_CHECKSUM_MISMATCH"
        with open(path, "w") as f:
            f.write(was)
    os.unlink(os.path.join(handle, part))
    with pytest.raises(WarehouseError) as e:
        engine.fetch(handle)
    assert e.value.code == "EXECUTION_RESULT_ARTIFACT_MISSING"


def test_dashboard_and_recovery(engine):
    engine.run("insert into a.s.t (id) values (1), (2)")
    lost = engine.log("a.s.t").stage(engine.spark.createDataFrame([(9,)], "id int"))
    assert engine.recover(0) == {lost: "aborted"}
    engine.table("a.s.t")
    held = engine.dashboard()
    assert held["tables"]["a.s.t"]["rows"] == 2 and held["tables"]["a.s.t"]["version"] == 1 and held["executors"] >= 1
    assert held["events"][-1] | {"event": "scan", "table": "a.s.t", "mode": "full"} == held["events"][-1]


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "root")
    script = tmp_path / "s.sql"
    script.write_text("create database a; create schema a.s; create table a.s.t (id int); insert into a.s.t values (41), (42)")
    assert cli.main(["--root", root, "--query-file", str(script)]) == 0
    assert cli.main(["--root", root, "--query", "select max(id) as m from a.s.t"]) == 0
    out = capsys.readouterr().out
    assert "INSERT_DISPATCHED" in out and "42" in out and "41" not in out
    assert cli.main(["--root", root, "--query", "select x from a.s.nope"]) == 1


def test_pruned_queries_open_few_files(spark):
    for name in ("scan_pruned", "scan_pruned_date", "scan_pruned_timestamp", "scan_pruned_decimal"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.pruning.kept < df.pruning.files, name
