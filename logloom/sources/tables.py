"""Parquet test tables and the message views rendered from them.

The views turn relational rows into log lines with a known true template, so
mining quality can be scored (``event_id`` is the true template id).  The SQL
is the same text DuckDB runs in the oracle, so both engines see equal lines.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        path = os.path.join(sf_dir, f"{n}.parquet")
        if os.path.exists(path):
            read_table(spark, sf_dir, n).createOrReplaceTempView(n)


# Message views.  Written in SQL both Spark and DuckDB accept.
EVENTS_LOG_SQL = """
SELECT event_id AS line_id, event_type AS event_id, CASE event_type
 WHEN 'click' THEN concat('User ', user_id, ' clicked on 10.0.', event_id % 250, '.', user_id % 250, ':8080')
 WHEN 'view' THEN concat('Rendered /page/', user_id, '/', event_id, ' in ', CAST(floor(value) AS BIGINT), ' sec')
 WHEN 'signup' THEN concat('New account created: id=', user_id, ', region=R', event_id % 7)
 WHEN 'purchase' THEN concat('Payment accepted amount=', CAST(floor(value) AS BIGINT), ' (order ', event_id, ')')
 ELSE concat('ERROR session ', event_id, ' failed: code=', user_id % 9, ' retry=', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END) END AS line
FROM events
"""

ORDERS_LOG_SQL = """
SELECT o_orderkey AS line_id, o_orderstatus AS event_id,
 concat('Order ', o_orderkey, ' for customer ', o_custkey, ' status ', o_orderstatus) AS line FROM orders
"""

LINEITEM_LOG_SQL = """
SELECT concat(l_returnflag, '|', l_linestatus) AS event_id,
 concat('Shipped ', CAST(l_quantity AS BIGINT), ' units of part ', l_partkey, ' from supplier ', l_suppkey,
        ' flag ', l_returnflag, ' state ', l_linestatus) AS line
FROM lineitem
"""

# The true template of every events_log event type.
EVENTS_TRUTH = [
    ("click", "User <*> clicked on <*>"),
    ("view", "Rendered <*> in <*> <*>"),
    ("signup", "New account created: id=<*>, region=<*>"),
    ("purchase", "Payment accepted amount=<*> (order <*>)"),
    ("error", "ERROR session <*> failed: code=<*> retry=<*>"),
]
ORDERS_TRUTH = [(s, f"Order <*> for customer <*> status {s}") for s in ("F", "O", "P")]

TRUTH_VALUES_SQL = "(VALUES " + ", ".join(f"('{e}', '{t}')" for e, t in EVENTS_TRUTH) + ") AS tt(event_id, template)"


# Messages that exercise the rarer rules: snake, camel and scoped tokens, values
# behind "=", nested brackets, adjacent wildcards, clusters of one content, of
# mixed lengths and with an undecided position.  event_id is the true template.
MESSAGES_LOG_SQL = """
SELECT event_id AS line_id, form AS event_id, CASE form
 WHEN 'snake' THEN concat('disk_cache ready on x', user_id % 7, 'z')
 WHEN 'camel' THEN concat('x', user_id % 5, 'z readBlock read Block for user u', user_id % 9, 'k')
 WHEN 'scoped' THEN concat('q', event_id % 4, 'w net::Socket opened')
 WHEN 'kv' THEN concat('limit=k', user_id % 6, ':v', event_id % 3, ' {a[b', event_id % 2, ']} done')
 WHEN 'wild' THEN concat('moved ', 1000 + event_id, ' ', 2000 + user_id, ' blocks')
 WHEN 'once' THEN concat('Shutdown complete', CASE WHEN event_id % 3 = 0 THEN ' now' ELSE '' END)
 WHEN 'mixed' THEN concat('Loaded x', event_id % 3, 'z', CASE WHEN event_id % 2 = 0 THEN concat(' y', user_id % 3, 'k') ELSE '' END)
 ELSE concat('Sent to ', CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END) END AS line
FROM (SELECT *, CASE event_id % 8 WHEN 0 THEN 'snake' WHEN 1 THEN 'camel' WHEN 2 THEN 'scoped' WHEN 3 THEN 'kv' WHEN 4 THEN 'wild'
 WHEN 5 THEN 'once' WHEN 6 THEN 'mixed' ELSE 'sent' END AS form FROM events)
"""
# The same and messages without any static token (every ninth event).
MIXED_LOG_SQL = f"""
SELECT line_id, event_id, line FROM ({MESSAGES_LOG_SQL})
UNION ALL SELECT -1 - event_id AS line_id, 'free' AS event_id, concat('x', event_id % 5, 'z q', user_id % 4, 'w') AS line FROM events WHERE event_id % 9 = 0
"""
# The true template of every message.
MESSAGES_TRUTH = [("snake", "disk_cache ready on <*>"), ("camel", "<*> readBlock read Block for user <*>"), ("scoped", "<*> net::Socket opened"),
                  ("kv", "limit=<*>:<*> {a[<*>]} done"), ("wild", "moved <*> blocks"), ("once", "Shutdown complete"),
                  ("mixed", "Loaded <*>"), ("sent", "Sent to <*>")]
MESSAGES_TRUTH_SQL = "(VALUES " + ", ".join(f"('{e}', '{t}')" for e, t in MESSAGES_TRUTH) + ") AS tt(event_id, template)"


# Every default mask's form (M1 to M13) in five places: between words, at the line's
# end and start, in brackets, and twice.  ``value`` is the form, ``masked`` what the
# rules make of it between words; a station code (M2) goes only between white space.
MASK_FORMS_SQL = """
SELECT event_id, form, place, value, masked, CASE WHEN form = 2 THEN value ELSE masked END AS outer_masked FROM (
 SELECT event_id, 1 + event_id % 13 AS form, CAST(floor(event_id / 13) AS BIGINT) % 5 AS place, CASE event_id % 13
  WHEN 0 THEN concat('Mon Jan ', 1 + user_id % 28, ' 10:11:12 ', CASE WHEN user_id % 2 = 0 THEN 'UTC ' ELSE '' END, '2020')
  WHEN 1 THEN concat('R0', user_id % 10)
  WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN '<*>  <*>' ELSE '<*> <*> <*>' END
  WHEN 3 THEN concat('fe80:0:0:0:1:2:', user_id % 10, ':4')
  WHEN 4 THEN concat('api', user_id, '.shop.example.', CASE WHEN user_id % 2 = 0 THEN 'com:443' ELSE 'io' END)
  WHEN 5 THEN concat(CASE WHEN user_id % 2 = 0 THEN 'hdfs://node' ELSE '10.1.2.' END, user_id % 200, ':8080')
  WHEN 6 THEN concat('/var/log/app', user_id, '.log')
  WHEN 7 THEN concat('00:1b:2c:3', CASE WHEN user_id % 2 = 0 THEN 'd' ELSE 'e:4f' END)
  WHEN 8 THEN concat('10.1.2.', user_id % 250)
  WHEN 9 THEN CASE user_id % 4 WHEN 0 THEN '0x1f' WHEN 1 THEN '0X1F' WHEN 2 THEN 'DEADBEEF' ELSE 'deadbeef' END
  WHEN 10 THEN concat(CASE user_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE '' END, user_id)
  WHEN 11 THEN concat(user_id, CASE WHEN user_id % 2 = 0 THEN ' KB' ELSE ' sec' END)
  ELSE concat('executed cmd "ls all ', user_id, ' x"') END AS value,
  CASE event_id % 13 WHEN 11 THEN '<*> <*>' WHEN 12 THEN 'executed cmd <*>' ELSE '<*>' END AS masked
 FROM events)
"""


def _placed(inner: str, outer: str) -> str:
    """The line of a form; ``inner`` stands between white space, ``outer`` at an edge or in brackets."""
    return (f"CASE place WHEN 0 THEN concat('job ', {inner}, ' done') WHEN 1 THEN concat('job ended at ', {outer}) "
            f"WHEN 2 THEN concat({outer}, ' begins') WHEN 3 THEN concat('see (', {outer}, '), next') "
            f"ELSE concat('pair ', {inner}, ' and ', {outer}) END")


MASK_LINES_SQL = f"SELECT event_id AS line_id, form, {_placed('value', 'value')} AS line FROM ({MASK_FORMS_SQL})"
MASK_TRUTH_SQL = f"SELECT event_id AS line_id, form, {_placed('masked', 'outer_masked')} AS content FROM ({MASK_FORMS_SQL})"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A message view over the events table."""
    read_table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(sql)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(EVENTS_LOG_SQL)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(ORDERS_LOG_SQL)


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume view.  It has no natural line order; ids follow the scan order."""
    from pyspark.sql import functions as F
    read_table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(LINEITEM_LOG_SQL).withColumn("line_id", F.monotonically_increasing_id())


def events_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """truth(line_id, event_id, template) for events_log."""
    read_table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(f"SELECT e.event_id AS line_id, e.event_type AS event_id, tt.template "
                     f"FROM events e JOIN {TRUTH_VALUES_SQL} ON e.event_type = tt.event_id")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents split into lines: (doc_id, line_no, line)."""
    read_table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql("SELECT doc_id, lang, p AS line_no, t AS line FROM documents "
                     "LATERAL VIEW posexplode(split(text, '\\n')) x AS p, t")
