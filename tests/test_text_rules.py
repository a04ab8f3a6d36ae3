"""Hand fixtures for the text rules (masks, tokenizer), worked out from the
rules themselves, checked in Spark and in the DuckDB rendering."""

import duckdb
import pytest

from logloom.functions.masking import mask_col
from logloom.functions.sqlexpr import DUCK
from logloom.functions.tokenizer import tokenize_expr, tokenize_sql

MASKS = [
    ("at Mon Jan 12 10:11:12 UTC 2020 boot", "at <*> boot"),
    ("node R04 down", "node <*> down"),
    ("a <*> <*> b", "a <*> b"),
    ("src fe80:0:0:0:1:2:3:4 ok", "src <*> ok"),
    ("to api.shop.example.com:443 now", "to <*> now"),
    ("peer 10.1.2.3:8080, up", "peer <*>, up"),
    ("open /var/log/app.log failed", "open <*> failed"),
    ("mac 00:1b:2c:3d seen", "mac <*> seen"),
    ("from 10.1.2.3 ok", "from <*> ok"),
    ("ptr 0x1f and DEADBEEF", "ptr <*> and <*>"),
    ("delta -5 and x5", "delta <*> and x5"),
    ("sent 3 KB in 2 sec", "sent <*> <*> in <*> <*>"),
    ('u executed cmd "ls all" ok', "u executed cmd <*> ok"),
]

TOKENS = [
    ("x,", ["x,"]), ("a=1,b=2", "a = 1 , b = 2".split()), ("k=v:w z", "k = v : w z".split()),
    ("a::b c", ["a::b", "c"]), ("...x y", [".", ".", ".", "x", "y"]), ("foo(bar) done", "foo ( bar ) done".split()),
    ("a(b c", ["a(", "b", "c"]), ("(order <*>)", "( order <*> )".split()), ("[<*>] up", "[ <*> ] up".split()),
    ("core.<*> dumped", ["<*>", "dumped"]), ("id-<*> ok", ["<*>", "ok"]), ("key:<*>, end", "key : <*> , end".split()),
    ("<*> <*> x", ["<*>", "x"]), ("<*>( <*> x", ["<*>", "<*>", "x"]), ("", []), ("a-b (x-y)", ["a-b", "(", "x-y", ")"]),
]


def test_mask_chain(spark):
    df = spark.createDataFrame([(a,) for a, _ in MASKS], "line string").select("line", mask_col(__import__(
        "pyspark.sql.functions", fromlist=["col"]).col("line")).alias("m"))
    got = {r.line: r.m for r in df.collect()}
    for a, b in MASKS:
        assert got[a] == b, (a, got[a], b)


def test_tokenizer_spark(spark):
    df = spark.createDataFrame([(a,) for a, _ in TOKENS], "m string").select("m", tokenize_expr("m").alias("t"))
    got = {r.m: list(r.t) for r in df.collect()}
    for a, b in TOKENS:
        assert got[a] == b, (a, got[a], b)


def test_tokenizer_duckdb_rendering():
    con = duckdb.connect()
    con.execute("CREATE TABLE t(m VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(a,) for a, _ in TOKENS])
    got = dict(con.execute(f"SELECT m, {tokenize_sql(DUCK, 'm')} FROM t").fetchall())
    for a, b in TOKENS:
        assert got[a] == b, (a, got[a], b)


@pytest.mark.parametrize("n,thr", [(1, 1.0), (2, 0.5), (3, 0.4717), (4, 0.5), (5, 0.5356), (8, 0.625), (16, 0.75)])
def test_dynamic_threshold(spark, n, thr):
    from pyspark.sql import functions as F
    from logloom.operators.similarity import dynamic_threshold
    v = spark.range(1).select(F.round(dynamic_threshold(F.lit(n)), 4).alias("t")).first().t
    assert v == thr
