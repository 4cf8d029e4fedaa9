"""The operators behind join_multi_key, join_timestamp_key and sort_multi over whole tables, against DuckDB."""

import duckdb
from pyspark.sql import functions as F

from millrace import queries as core
from millrace.operators.relational import aggregate, join, sort

DATA = "/root/testdata/sf0.001"


def rows(sql):
    db = duckdb.connect()
    for t in ("lineitem", "orders"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db.sql(sql).fetchall()


def test_multi_key_join(spark):
    lines = core.Tables(spark, DATA).lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    both = join(lines.drop("l_quantity"), lines, [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")], "b")
    want = rows("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
    assert sorted(map(tuple, both.select("l_orderkey", "l_linenumber", "l_quantity").collect())) == sorted(want)


def test_timestamp_key_join(spark):
    t = core.Tables(spark, DATA)
    want = rows("SELECT count(*) FROM orders o JOIN lineitem l ON o.o_orderdate = l.l_shipdate")
    assert [tuple(r) for r in core.counted(join(t.orders, t.lineitem, [("o_orderdate", "l_shipdate")], "lineitem")).collect()] == want
    # counted by date first, the same number
    a, b = aggregate(t.orders, ["o_orderdate"], [("count", "*", "a")]), aggregate(t.lineitem, ["l_shipdate"], [("count", "*", "b")])
    assert [tuple(r) for r in join(a, b, [("o_orderdate", "l_shipdate")], "b").agg(F.sum(F.col("a") * F.col("b"))).collect()] == want


def test_sort_keeps_all_rows_with_nulls_last(spark):
    got = [tuple(r) for r in sort(core.status(core.Tables(spark, DATA)), "st", ("o_orderkey", "desc")).select("st", "o_orderkey").collect()]
    assert got == rows("SELECT nullif(o_orderstatus, 'P') AS st, o_orderkey FROM orders ORDER BY st ASC NULLS LAST, o_orderkey DESC")
    assert got[0][0] == "F" and got[-1][0] is None
