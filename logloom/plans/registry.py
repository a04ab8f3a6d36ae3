"""Query registry: one Spark job per SURVEY operator, plus DuckDB oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLES[name]`` is the
DuckDB SQL over the same parquet tables (omitted for rows-only checks).
Column names and types agree between the two; floats are rounded.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokenizer as tk
from ..functions.masking import WILDCARD, preprocess_sql
from ..functions.sqlexpr import DUCK as D
from ..operators import induction, matching, merging, metrics, params, runs, similarity
from ..operators.preprocess import dataset_mask, distinct_contents, drop_patterns, mask_hits, mask_lines, preprocess
from ..operators.tokens import classified_tokens, identifier_tokens, token_flags, token_table
from ..session import shared_path, written
from ..sources import layouts, raw_logs, tables
from .oracle import EVENTS_CATALOG_SQL, EVENTS_MASKED_SQL, EVENTS_TEMPLATE_SQL, _q, with_pipeline
from .settings import EVENTS_REGEX, NAMED_RULES
from .vpipe import vpipe

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _bigint(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ----------------------------------------------------------------- sources ---
# Raw log lines rendered from events in a Linux-like layout; every 11th event
# has no "[pid]" (optional group) and every 13th a broken header (dropped).
RAW_FORMAT = "<Month> <Date> <Time> <Level> <Component>(\\[<PID>\\])?: <Content>"
RAW_LINES_SQL = """
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN concat('garbage ', event_id)
 ELSE concat('Jun ', CAST(1 + event_id % 28 AS STRING), ' ', lpad(CAST(event_id % 24 AS STRING), 2, '0'), ':',
             lpad(CAST(user_id % 60 AS STRING), 2, '0'), ':00 combo ', event_type,
             CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('[', CAST(user_id AS STRING), ']') END,
             ': value ', CAST(CAST(floor(value) AS BIGINT) AS STRING), '  ') END AS line
FROM events
"""


def _raw_lines(spark, sf):
    tables.register_tables(spark, sf, ["events"])
    return spark.sql(RAW_LINES_SQL)


@query("header_parse", """
WITH raw AS ({raw}), m AS (
 SELECT event_id, trim(line) AS s FROM raw),
 p AS (SELECT event_id, {cols} FROM m WHERE regexp_matches(s, {pat}))
SELECT CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS LineId, Month, Date, Time, Level, Component, PID, Content FROM p
""")
def q_header_parse(spark, sf):
    hf = raw_logs.compile_header(RAW_FORMAT)
    parsed = raw_logs.parse_headers(_raw_lines(spark, sf), hf)
    return raw_logs.number_rows(parsed, "event_id").select("LineId", *hf.headers)


def _header_oracle():
    hf = raw_logs.compile_header(RAW_FORMAT)
    cols = []
    for h in hf.headers:
        e = f"regexp_extract(s, {_q(hf.regex)}, {hf.group_of[h]})"
        cols.append((f"nullif({e}, '')" if h in hf.optional else e) + f" AS {h}")
    return ORACLES["header_parse"].format(raw=RAW_LINES_SQL, cols=", ".join(cols), pat=_q(hf.regex))


ORACLES["header_parse"] = _header_oracle()


@query("raw_log_scan", ORACLES["header_parse"])
def q_raw_log_scan(spark, sf):
    """S2 on text files: the lines are written in order and scanned with their numbers."""
    path = shared_path(spark)
    _raw_lines(spark, sf).orderBy("event_id").select("line").write.text(path)
    hf = raw_logs.compile_header(RAW_FORMAT)
    return raw_logs.read_raw_logs(spark, path, RAW_FORMAT).select("LineId", *hf.headers)


@query("structured_scan", f"""
WITH l AS ({tables.EVENTS_LOG_SQL})
SELECT CAST(l.line_id AS BIGINT) AS LineId, l.line AS Content, l.event_id AS EventId, tt.template AS EventTemplate
FROM l JOIN {tables.TRUTH_VALUES_SQL} ON l.event_id = tt.event_id
""")
def q_structured_scan(spark, sf):
    """S3: the structured log table, written as CSV and scanned."""
    lines = tables.events_log(spark, sf)
    truth = spark.sql(f"SELECT * FROM {tables.TRUTH_VALUES_SQL}")
    path = shared_path(spark)
    (lines.join(truth, "event_id")
     .select(F.col("line_id").cast("bigint").alias("LineId"), F.col("line").alias("Content"),
             F.col("event_id").alias("EventId"), F.col("template").alias("EventTemplate"))
     .write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return raw_logs.read_structured(spark, path)


ORDERS_TRUTH_SQL = ("SELECT o_orderkey AS line_id, o_orderstatus AS event_id, "
                    "concat('Order <*> for customer <*> status ', o_orderstatus) AS template FROM orders")


@query("truth_catalog", f"""
SELECT event_id, template, CAST(count(*) AS BIGINT) AS occurrence FROM ({ORDERS_TRUTH_SQL}) GROUP BY event_id, template
""")
def q_truth_catalog(spark, sf):
    """Template catalog of orders_log, written as CSV with its headers and scanned."""
    tables.register_tables(spark, sf, ["orders"])
    path = shared_path(spark)
    (metrics.occurrence(spark.sql(ORDERS_TRUTH_SQL))
     .select(F.col("event_id").alias("EventID"), F.col("template").alias("EventTemplate"), F.col("occurrence").alias("Occurrence"))
     .write.csv(path, header=True, escape='"'))
    return raw_logs.read_truth_catalog(spark, path)


RUNLOG_SQL = """
SELECT event_id AS seq, concat('INFO - Evaluation on Dataset: ', event_type,
 ', Group Accuracy: 0.', lpad(CAST((user_id * 37 + event_id) % 10000 AS STRING), 4, '0'),
 ', PA Accuracy: 0.', lpad(CAST((event_id * 13) % 10000 AS STRING), 4, '0'),
 ', FGA: 0.', lpad(CAST((user_id * 7) % 10000 AS STRING), 4, '0'),
 ', FTA: 0.', lpad(CAST((event_id * 3 + user_id) % 10000 AS STRING), 4, '0'),
 ', Duration: ', CAST(event_id % 50 AS STRING), '.', lpad(CAST(user_id % 100 AS STRING), 2, '0'),
 ' sec, Total of 2000 lines, rate ', CAST(100 + event_id % 700 AS STRING), '.5 lines/sec, ',
 CAST(user_id % 60 AS STRING), ' templates, Total LLM Call count: ', CAST(event_id % 20 AS STRING),
 ', Total LLM Call Tokens: ', CAST(user_id * 97 AS STRING)) AS line
FROM events
"""
def _only_group(pattern: str, k: int) -> str:
    """The pattern with every capturing group but the k-th made non-capturing
    (DuckDB reads at most nine numbered groups)."""
    out, n, i = [], 0, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if pattern[i] == "(" and not pattern.startswith("(?", i):
            n += 1
            out.append("(" if n == k else "(?:")
        else:
            out.append(pattern[i])
        i += 1
    return "".join(out)


_RUN_COLS = ", ".join(
    f"CAST(regexp_extract(line, {_q(_only_group(runs.RUN_LINE_RE, i + 1))}, 1) AS {t.upper()}) AS {n}" if t != "string" else
    f"regexp_extract(line, {_q(_only_group(runs.RUN_LINE_RE, i + 1))}, 1) AS {n}"
    for i, (n, t) in enumerate(runs.RUN_FIELDS))
RUNS_ORACLE_CTE = (f"r AS ({RUNLOG_SQL}), runs AS (SELECT CAST(seq AS BIGINT) AS seq, {_RUN_COLS} FROM r "
                   f"WHERE regexp_matches(line, {_q(runs.RUN_LINE_RE)}))")


def _runs(spark, sf):
    tables.register_tables(spark, sf, ["events"])
    return runs.read_runs(spark.sql(RUNLOG_SQL).withColumn("seq", F.col("seq").cast("bigint")))


@query("runlog_scan", f"WITH {RUNS_ORACLE_CTE} SELECT * FROM runs")
def q_runlog_scan(spark, sf):
    return _runs(spark, sf)


@query("best_run", f"WITH {RUNS_ORACLE_CTE} SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER "
                   f"(PARTITION BY dataset ORDER BY ga DESC, seq ASC) AS rk FROM runs) WHERE rk = 1")
def q_best_run(spark, sf):
    return runs.best_run(_runs(spark, sf))


_METRICS = ", ".join(runs.METRIC_COLS)


@query("leaderboard", f"""WITH {RUNS_ORACLE_CTE},
 best AS (SELECT dataset, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in runs.METRIC_COLS)} FROM
   (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ga DESC, seq ASC) AS rk FROM runs) WHERE rk = 1)
SELECT * FROM best UNION ALL SELECT 'Average' AS dataset, {", ".join(f"round(avg({c}), 4) AS {c}" for c in runs.METRIC_COLS)} FROM best
""")
def q_leaderboard(spark, sf):
    return runs.leaderboard(_runs(spark, sf))


@query("run_summary_files", ORACLES["leaderboard"])
def q_run_summary_files(spark, sf):
    """Run logs as text files, scanned; the leaderboard written as CSV and read back."""
    tables.register_tables(spark, sf, ["events"])
    logs, out = shared_path(spark), shared_path(spark)
    spark.sql(RUNLOG_SQL).orderBy("seq").select("line").write.text(logs)
    runs.write_summary(runs.leaderboard(runs.read_run_files(spark, logs)), out)
    return spark.read.csv(out, header=True, schema="dataset string, " + ", ".join(f"{c} double" for c in runs.METRIC_COLS))


MULTI_SQL = (f"SELECT 'events' AS dataset, line_id, line FROM ({tables.EVENTS_LOG_SQL}) "
             f"UNION ALL SELECT 'orders' AS dataset, line_id, line FROM ({tables.ORDERS_LOG_SQL})")
MULTI_RULES = {"events": {"regex": EVENTS_REGEX, "filter": []},
               "orders": {"regex": [r"\d+"], "filter": [r" for customer \d+"]}}


def _multi_oracle():
    cases = " ".join(f"WHEN dataset = '{d}' THEN {preprocess_sql(D, 'line', s['regex'], s['filter'])}"
                     for d, s in MULTI_RULES.items())
    return f"SELECT dataset, CAST(line_id AS BIGINT) AS line_id, CASE {cases} END AS content FROM ({MULTI_SQL})"


@query("multi_dataset", _multi_oracle())
def q_multi_dataset(spark, sf):
    """One job over several datasets, each with its own P1/P2 rules."""
    from ..functions.masking import preprocess_col
    tables.register_tables(spark, sf, ["events", "orders"])
    df = spark.sql(MULTI_SQL)
    expr = None
    for d, s in MULTI_RULES.items():
        c = preprocess_col(F.col("line"), s["regex"], s["filter"], rules=[])
        expr = F.when(F.col("dataset") == d, c) if expr is None else expr.when(F.col("dataset") == d, c)
    return df.select("dataset", F.col("line_id").cast("bigint").alias("line_id"), expr.alias("content"))


# Lines in every known layout: event e is written in layout e % 18, every eleventh
# without its optional header part, every thirteenth with a broken header.
LAYOUT_MESSAGE_SQL = """concat('job ', event_id, ' HTTP/1.1 a-b-c-d-e 10.0.1.2,10.0.3.4 blk_-', user_id, ' LOCAL(3) x_A7 took 10:11:12 (12.5 KB) <3 sec MB of www.shop.org:80 ',
 'id ', user_id, ' at /usr/lib/m', user_id % 9, '.so')"""


def _layout_line(fmt: str) -> str:
    """SQL of a header in layout ``fmt`` whose fields hold their name and the user's number, without the content."""
    full = re.sub(r"\(((?:\\.|[^()\\])*)\)\?", "\0\\1\0", fmt.replace("<Content>", ""))
    out = []
    for k, part in enumerate(full.split("\0")):
        bits = [f"concat({_q(b[1:-1].lower())}, user_id % 50)" if b.startswith("<") else _q(re.sub(r"\\(.)", r"\1", b))
                for b in re.split(r"(<[^<>]+>)", part) if b]
        text = f"concat({', '.join(bits)}, '')" if bits else "''"
        out.append(f"CASE WHEN event_id % 11 = 0 THEN '' ELSE {text} END" if k % 2 else text)
    return f"concat({', '.join(out)}, '')"


_LAYOUT_OF = f"CASE event_id % {len(layouts.LAYOUTS)} " + " ".join(f"WHEN {i} THEN {_q(r[0])}" for i, r in enumerate(layouts.LAYOUTS)) + " END"
LAYOUT_LINES_SQL = (f"SELECT event_id, dataset, message, CASE WHEN event_id % 13 = 0 THEN 'broken' ELSE concat(CASE dataset "
                    + " ".join(f"WHEN {_q(d)} THEN {_layout_line(f)}" for d, f, _, _ in layouts.LAYOUTS)
                    + f" END, message, '  ') END AS line FROM (SELECT *, {_LAYOUT_OF} AS dataset, {LAYOUT_MESSAGE_SQL} AS message FROM events)")


def _layout_oracle():
    cases = " ".join(f"WHEN {_q(d)} THEN {preprocess_sql(D, 'message', masks, drops)}" for d, _, masks, drops in layouts.LAYOUTS)
    return (f"SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY event_id) AS BIGINT) AS LineId, "
            f"CASE WHEN dataset IN ('Thunderbird', 'Linux', 'Thunderbird_epd') AND event_id % 11 <> 0 OR dataset = 'Mac' THEN concat('pid', user_id % 50) END AS pid, "
            f"CASE dataset {cases} END AS content FROM ({LAYOUT_LINES_SQL.replace('SELECT event_id, dataset', 'SELECT event_id, user_id, dataset', 1)}) WHERE event_id % 13 <> 0")


@query("layout_scan", _layout_oracle())
def q_layout_scan(spark, sf):
    """Lines in all known layouts parsed, masked and numbered per dataset in one job; the oracle knows fields and message."""
    tables.register_tables(spark, sf, ["events"])
    parsed = layouts.for_datasets(spark.sql(LAYOUT_LINES_SQL), layouts.layouts(spark), fields=("PID",))
    rows = parsed.select("event_id", "dataset", F.col("PID").alias("pid"), "content")
    return raw_logs.number_rows(rows, "event_id", by=("dataset",)).select("dataset", "LineId", "pid", "content")


# ------------------------------------------------------------ preprocessing ---
DROP_URL = [r"\?[^#]*", r"#.*$"]
URL_MASK = [r"([\w-]+\.)+[\w-]+(:\d+)?", r"/\d+"]


@query("drop_patterns", "SELECT CAST(page_id AS BIGINT) AS page_id, " +
       "".join("regexp_replace(" for _ in DROP_URL) + "url" +
       "".join(f", {_q(p)}, '', 'g')" for p in DROP_URL) + " AS content FROM pages")
def q_drop_patterns(spark, sf):
    """P1 on page URLs: query strings and fragments removed, rows kept."""
    pages = tables.read_table(spark, sf, "pages").select(F.col("page_id").cast("bigint"), F.col("url").alias("line"))
    return drop_patterns(pages, DROP_URL).select("page_id", "content")


@query("dataset_mask", "SELECT CAST(page_id AS BIGINT) AS page_id, " +
       "".join("regexp_replace(" for _ in URL_MASK) + "url" +
       "".join(f", {_q(p)}, '<*>', 'g')" for p in URL_MASK) + " AS content FROM pages")
def q_dataset_mask(spark, sf):
    """P2 on page URLs: host names and numeric path parts become ``<*>``."""
    pages = tables.read_table(spark, sf, "pages").select(F.col("page_id").cast("bigint"), F.col("url").alias("line"))
    return dataset_mask(pages, URL_MASK).select("page_id", "content")


@query("mask_chain", f"SELECT CAST(event_id AS BIGINT) AS line_id, {EVENTS_MASKED_SQL} AS content FROM events")
def q_mask_chain(spark, sf):
    """P3/P6 with the 13 default rules; the oracle renders the masked lines from their columns."""
    lines = tables.events_log(spark, sf)
    return mask_lines(lines).select(F.col("line_id").cast("bigint").alias("line_id"), "content")


@query("mask_forms", f"SELECT CAST(line_id AS BIGINT) AS line_id, CAST(form AS BIGINT) AS form, content FROM ({tables.MASK_TRUTH_SQL})")
def q_mask_forms(spark, sf):
    """Every default mask's forms in five places of a line; the oracle puts ``<*>`` where the form was put."""
    lines = tables.view(spark, sf, tables.MASK_LINES_SQL)
    return mask_lines(lines).select(*_bigint("line_id", "form"), "content")


def _named_sql(expr):
    out = expr
    for p, name in NAMED_RULES:
        out = f"regexp_replace({out}, {_q(p)}, '<{name}>', 'g')"
    return out


@query("named_masks", f"WITH l AS ({tables.EVENTS_LOG_SQL}) SELECT CAST(line_id AS BIGINT) AS line_id, "
                      f"{_named_sql(preprocess_sql(D, 'line'))} AS content FROM l")
def q_named_masks(spark, sf):
    """Each rule masks with its own name, ``<NAME>``."""
    lines = tables.events_log(spark, sf)
    return mask_lines(lines, NAMED_RULES).select(F.col("line_id").cast("bigint").alias("line_id"), "content")


def _hits_oracle():
    cur = preprocess_sql(D, "line")
    parts = []
    for i, (p, name) in enumerate(NAMED_RULES):
        parts.append(f"SELECT {i + 1} AS rule_no, '{name}' AS mask_name, CAST(sum(len(regexp_extract_all({cur}, {_q(p)}))) AS BIGINT) AS hits FROM l")
        cur = f"regexp_replace({cur}, {_q(p)}, '<{name}>', 'g')"
    return f"WITH l AS ({tables.EVENTS_LOG_SQL}) " + " UNION ALL ".join(parts)


@query("mask_hits", _hits_oracle())
def q_mask_hits(spark, sf):
    """P5: hits per rule on the text entering that rule."""
    return mask_hits(tables.events_log(spark, sf), NAMED_RULES)


@query("distinct_content", with_pipeline("SELECT content, CAST(n AS BIGINT) AS n, CAST(min_line AS BIGINT) AS min_line, "
                                         "CAST(max_line AS BIGINT) AS max_line FROM dm"))
def q_distinct_content(spark, sf):
    v = vpipe(spark, sf)
    return v.dm.select("content", *_bigint("n", "min_line", "max_line"))


#: the messages view, for rules that the events never reach
MESSAGES = {"lines_sql": tables.MESSAGES_LOG_SQL, "truth_sql": tables.MESSAGES_TRUTH_SQL}
MIXED = {"lines_sql": tables.MIXED_LOG_SQL, "truth_sql": tables.MESSAGES_TRUTH_SQL}


# ------------------------------------------------------------- tokenizer ---
DOC_LINES_SQL = "SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)"


def _doc_lines(spark, sf):
    return tables.doc_lines(spark, sf).select("line").distinct()


def _doc_tokens(spark, sf):
    return (_doc_lines(spark, sf).select(F.explode(F.split(F.regexp_replace("line", ",", ", "),
                                                            tk.WS_CLASS + "+")).alias("t"))
            .where("t <> ''").distinct())


DOC_TOKENS_SQL = (f"SELECT DISTINCT t FROM (SELECT unnest(string_split_regex(replace(line, ',', ', '), "
                  f"{_q(tk.WS_CLASS + '+')})) AS t FROM ({DOC_LINES_SQL})) WHERE t <> ''")


@query("tokens_basic", f"SELECT line, array_to_string(list_filter(string_split_regex(replace(line, ',', ', '), "
                       f"{_q(tk.WS_CLASS + '+')}), lambda x: x <> ''), ' ') AS basic FROM ({DOC_LINES_SQL})")
def q_tokens_basic(spark, sf):
    """Comma spacing and whitespace split, on document lines."""
    return _doc_lines(spark, sf).select("line", F.expr(
        f"array_join(filter(split(replace(line, ',', ', '), r'{tk.WS_CLASS}+'), x -> x <> ''), ' ')").alias("basic"))


def _edge_sql(d, t):
    f = d.extract(t, "^" + tk.PUNCT + "*", 0)
    r = f"substring({t}, length({f}) + 1)"
    b = d.extract(r, tk.PUNCT + "*$", 0)
    return f, r, b


@query("edge_punct", f"SELECT t, {_edge_sql(D, 't')[0]} AS front, {_edge_sql(D, 't')[2]} AS back FROM ({DOC_TOKENS_SQL})")
def q_edge_punct(spark, sf):
    """Leading / trailing punctuation runs of every distinct token."""
    from ..functions.sqlexpr import SPARK as S
    f, _, b = _edge_sql(S, "t")
    return _doc_tokens(spark, sf).select("t", F.expr(f).alias("front"), F.expr(b).alias("back"))


@query("kv_split", f"SELECT t, array_to_string({D.let('_m', 't', tk._kv_split(D, '_m'))}, ' ') AS pieces FROM ({DOC_TOKENS_SQL})")
def q_kv_split(spark, sf):
    """T4 on every distinct whitespace token of the document lines."""
    from ..functions.sqlexpr import SPARK as S
    return _doc_tokens(spark, sf).select("t", F.expr(f"array_join({S.let('_m', 't', tk._kv_split(S, '_m'))}, ' ')").alias("pieces"))


@query("bracket_split", f"SELECT t, array_to_string({tk._bracket_split(D, 't')}, ' ') AS pieces FROM ({DOC_TOKENS_SQL})")
def q_bracket_split(spark, sf):
    """T5 on every distinct whitespace token of the document lines."""
    from ..functions.sqlexpr import SPARK as S
    return _doc_tokens(spark, sf).select("t", F.expr(f"array_join({tk._bracket_split(S, 't')}, ' ')").alias("pieces"))


_MSG_TOKENS_SQL = (f"SELECT DISTINCT t FROM (SELECT unnest(string_split_regex(replace(content, ',', ', '), "
                   f"{_q(tk.WS_CLASS + '+')})) AS t FROM dm) WHERE t <> '' AND instr(t, '<*>') > 0")


@query("wildcard_absorb", with_pipeline(f"SELECT t, array_to_string({tk._token_pieces(D, 't')}, ' ') AS pieces FROM ({_MSG_TOKENS_SQL})"))
def q_wildcard_absorb(spark, sf):
    """T6 on every distinct message token holding ``<*>``."""
    from ..functions.sqlexpr import SPARK as S
    v = vpipe(spark, sf)
    toks = (v.dm.select(F.explode(F.split(F.regexp_replace("content", ",", ", "), tk.WS_CLASS + "+")).alias("t"))
            .where("t <> '' AND instr(t, '<*>') > 0").distinct())
    return toks.select("t", F.expr(f"array_join({tk._token_pieces(S, 't')}, ' ')").alias("pieces"))


@query("tokenize", with_pipeline("SELECT content, array_to_string(tokens, ' ') AS canon, CAST(len(tokens) AS BIGINT) AS n_tokens FROM tok", **MESSAGES))
def q_tokenize(spark, sf):
    """T9 on the distinct masked event messages."""
    v = vpipe(spark, sf, **MESSAGES)
    t = v.dm.select("content", tk.tokenize_expr("content").alias("tokens"))
    return t.select("content", F.array_join("tokens", " ").alias("canon"), F.size("tokens").cast("bigint").alias("n_tokens"))


@query("collapse_wild", "SELECT DISTINCT 'moved <*> <*> blocks' AS content, 'moved <*> blocks' AS canon FROM events WHERE event_id % 8 = 4")
def q_collapse_wild(spark, sf):
    """Neighbouring wildcards become one; the view renders them in one form of message."""
    dm = vpipe(spark, sf, **MESSAGES).dm.where("instr(content, '<*> <*>') > 0")
    return dm.select("content", F.array_join(tk.tokenize_expr("content"), " ").alias("canon"))


@query("tokenize_text", f"SELECT line, array_to_string({tk.tokenize_sql(D, 'line')}, ' ') AS canon FROM ({DOC_LINES_SQL})")
def q_tokenize_text(spark, sf):
    """T9 on every distinct document line (free text, whole lines)."""
    return _doc_lines(spark, sf).select("line", F.array_join(tk.tokenize_expr("line"), " ").alias("canon"))


@query("token_table", with_pipeline("SELECT canon, pos, token FROM tt"))
def q_token_table(spark, sf):
    v = vpipe(spark, sf)
    return token_table(v.cc).select("canon", F.col("pos").cast("bigint").alias("pos"), "token")


# -------------------------------------------------------- classification ---
@query("vocabulary", with_pipeline("SELECT token FROM vocab"))
def q_vocabulary(spark, sf):
    return vpipe(spark, sf).vocab.select("token")


@query("static_tokens", with_pipeline("SELECT canon, pos, token, is_static FROM st2", **MESSAGES))
def q_static_tokens(spark, sf):
    v = vpipe(spark, sf, **MESSAGES)
    return classified_tokens(v.cc, v.vocab).select("canon", F.col("pos").cast("bigint").alias("pos"), "token", "is_static")


@query("identifier_tokens", f"SELECT DISTINCT t AS token FROM ({DOC_TOKENS_SQL}) WHERE regexp_matches(t, '^[a-z]+(_[a-z]+)+$') "
                            f"OR regexp_matches(t, '^[a-zA-Z]+([A-Z][a-z0-9]+)+$')")
def q_identifier_tokens(spark, sf):
    """C7 over distinct document tokens."""
    toks = _doc_tokens(spark, sf).select(F.array(F.col("t")).alias("tokens"), F.lit("x").alias("canon"))
    return identifier_tokens(toks).select("token").distinct()


@query("camel_tokens", with_pipeline("SELECT token FROM camel", **MESSAGES))
def q_camel_tokens(spark, sf):
    """C4: camel-case tokens with a part in the vocabulary."""
    v = vpipe(spark, sf, **MESSAGES)
    return token_flags(token_table(v.cc), v.vocab).where("camel_ok").select("token")


@query("static_key", with_pipeline("SELECT canon, static_key FROM keyed", **MESSAGES))
def q_static_key(spark, sf):
    return vpipe(spark, sf, **MESSAGES).keyed.select("canon", "static_key")


@query("static_groups", with_pipeline("SELECT static_key, CAST(count(*) AS BIGINT) AS n_contents, CAST(sum(n) AS BIGINT) AS n_lines "
                                      "FROM keyed GROUP BY static_key"))
def q_static_groups(spark, sf):
    """One group per static key."""
    return (vpipe(spark, sf).keyed.groupBy("static_key")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_contents"), F.sum("n").cast("bigint").alias("n_lines")))


@query("catch_all", with_pipeline("SELECT canon, CAST(n AS BIGINT) AS n FROM keyed WHERE static_key = '<*>'", **MIXED))
def q_catch_all(spark, sf):
    """Contents routed to similarity clustering."""
    return vpipe(spark, sf, **MIXED).keyed.where(F.col("static_key") == WILDCARD).select("canon", F.col("n").cast("bigint"))


# ------------------------------------------------------------- induction ---
@query("length_profile", with_pipeline("SELECT cluster_key, CAST(n_contents AS BIGINT) AS n_contents, n_lines, "
                                       "CAST(min_len AS BIGINT) AS min_len, CAST(max_len AS BIGINT) AS max_len, "
                                       "CAST(first_line AS BIGINT) AS first_line, path FROM prof", **MESSAGES))
def q_length_profile(spark, sf):
    p = induction.length_profile(vpipe(spark, sf, **MESSAGES).clusters)
    return p.select("cluster_key", *_bigint("n_contents", "n_lines", "min_len", "max_len", "first_line"), "path")


@query("single_content", with_pipeline("SELECT cluster_key, canon AS template FROM clusters JOIN prof USING (cluster_key) "
                                       "WHERE path = 'single'", **MESSAGES))
def q_single_content(spark, sf):
    """A cluster with one distinct content is its own template."""
    return induction.single_content(vpipe(spark, sf, **MESSAGES).clusters).select("cluster_key", "template")


def _pos_stats(spark, sf):
    v = vpipe(spark, sf, **MESSAGES)
    c = v.clusters
    same = c.join(induction.length_profile(c).where("path = 'same'").select("cluster_key"), "cluster_key")
    return induction.position_entropy(same, v.vocab)


@query("position_entropy", with_pipeline("SELECT cluster_key, CAST(pos AS BIGINT) AS pos, CAST(n_tok AS BIGINT) AS n_tok, "
                                         "has_wild, round(entropy, 6) AS entropy FROM ps", **MESSAGES))
def q_position_entropy(spark, sf):
    """Column wildcarding and line-weighted entropy per position."""
    ps = _pos_stats(spark, sf)
    return ps.select("cluster_key", *_bigint("pos", "n_tok"), "has_wild", F.round("entropy", 6).alias("entropy"))


@query("position_decision", with_pipeline("SELECT cluster_key, CAST(pos AS BIGINT) AS pos, decision FROM dec", **MESSAGES))
def q_position_decision(spark, sf):
    d = induction.position_decision(_pos_stats(spark, sf))
    return d.select("cluster_key", F.col("pos").cast("bigint").alias("pos"), "decision")


@query("position_decision_alt", with_pipeline("SELECT cluster_key, CAST(pos AS BIGINT) AS pos, decision_alt AS decision FROM dec", **MESSAGES))
def q_position_decision_alt(spark, sf):
    """The older entropy rule as a second decision profile."""
    d = induction.position_decision(_pos_stats(spark, sf), profile="alt")
    return d.select("cluster_key", F.col("pos").cast("bigint").alias("pos"), "decision")


@query("assemble_template", with_pipeline("SELECT cluster_key, all_decided, template FROM asm", **MESSAGES))
def q_assemble_template(spark, sf):
    a = induction.assemble(induction.position_decision(_pos_stats(spark, sf)))
    return a.select("cluster_key", "all_decided", "template")


@query("unique_fallback", with_pipeline("SELECT cluster_key, canon, wcontent AS template FROM wc WHERE NOT all_decided", **MESSAGES))
def q_unique_fallback(spark, sf):
    """Undecided clusters -> one template per distinct wildcarded content."""
    v = vpipe(spark, sf, **MESSAGES)
    c = v.clusters
    same = c.join(induction.length_profile(c).where("path = 'same'").select("cluster_key"), "cluster_key")
    a = induction.assemble(induction.position_decision(induction.position_entropy(same, v.vocab)))
    return induction.unique_fallback(induction.wildcarded(same.join(a.where("NOT all_decided").drop("template"), "cluster_key")), "wcontent")


@query("arbitration_queue", with_pipeline("""
SELECT cluster_key, 1 AS mode, CAST(rk AS BIGINT) AS rank, wcontent AS sample FROM (
  SELECT cluster_key, wcontent, row_number() OVER (PARTITION BY cluster_key ORDER BY fs, wcontent) AS rk
  FROM (SELECT cluster_key, wcontent, min(min_line) AS fs FROM wc WHERE NOT all_decided GROUP BY ALL)) WHERE rk <= 5
UNION ALL
SELECT cluster_key, 2 AS mode, CAST(row_number() OVER (PARTITION BY cluster_key ORDER BY len(tokens), min_line) AS BIGINT) AS rank,
  canon AS sample FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.cluster_key, len(c.tokens) ORDER BY c.min_line) AS r
  FROM clusters c JOIN prof p USING (cluster_key) WHERE p.path = 'mixed') WHERE r = 1
""", **MESSAGES))
def q_arbitration_queue(spark, sf):
    """I8: what an arbiter would be asked, ranked filters only."""
    v = vpipe(spark, sf, **MESSAGES)
    q = induction.arbitration_queue(v.clusters, v.vocab)
    return q.select("cluster_key", F.col("mode").cast("int"), F.col("rank").cast("bigint"), "sample")


@query("frequency_split", with_pipeline("""
SELECT cluster_key, canon, canon AS template FROM (
 SELECT *, count(*) OVER w AS types, sum(n) OVER w AS tot, max(n) OVER w AS top FROM clusters WINDOW w AS (PARTITION BY cluster_key))
WHERE top * types >= tot"""))
def q_frequency_split(spark, sf):
    """I12 (the reference never calls it): split when top share >= 1/types."""
    return induction.frequency_split(vpipe(spark, sf).clusters)


@query("read_decisions", with_pipeline(
    "SELECT cluster_key, CASE WHEN n_contents % 2 = 0 THEN '' ELSE concat('{', replace(fc, '\"', ''), '}') END AS template FROM "
    "(SELECT cluster_key, count(*) AS n_contents, arg_min(canon, min_line) AS fc FROM clusters GROUP BY cluster_key)"))
def q_read_decisions(spark, sf):
    """Last balanced JSON object of an answer (braces inside it, and after it) -> template ('' = none)."""
    c = vpipe(spark, sf).clusters
    ans = (c.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n_contents"), F.min_by("canon", "min_line").alias("fc"))
           .select("cluster_key", F.concat(
               F.lit('} Output-1: {"position": 1, "result": "variable"} Output-2: {"why": {"a": {}}, "template": "'),
               F.when(F.col("n_contents") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("{"), F.regexp_replace("fc", '"', ""), F.lit("}"))),
               F.lit('"} } end {')).alias("answer")))
    return induction.read_decisions(ans)


def _induced(v, decisions=False):
    """Every content with its template and cluster (single, same-length and mixed clusters)."""
    c = v.clusters
    dec = None
    if decisions:
        dec = (c.groupBy("cluster_key").agg(F.min_by("canon", "min_line").alias("fc"), F.count(F.lit(1)).alias("k"))
               .select("cluster_key", F.when(F.col("k") % 3 == 0, F.col("fc")).otherwise(F.lit("")).alias("template")))
    out = induction.induce(c, v.vocab, dec)
    return out.join(c.select("cluster_key", "canon", "n", "min_line"), ["cluster_key", "canon"]).checkpoint()


_INDUCE_SAME_SQL = """
SELECT c.cluster_key, c.canon, c.canon AS template FROM clusters c JOIN prof p USING (cluster_key) WHERE p.path = 'single'
UNION ALL SELECT cluster_key, canon, CASE WHEN all_decided THEN asm_template ELSE wcontent END AS template FROM wc"""


@query("induce_templates", with_pipeline(_INDUCE_SAME_SQL + """
UNION ALL SELECT c.cluster_key, c.canon, 'Loaded <*>' AS template FROM clusters c JOIN prof p USING (cluster_key) WHERE p.path = 'mixed'""", **MESSAGES))
def q_induce_templates(spark, sf):
    """I1-I7 + I11: template of every content; the one mixed cluster of the view is known by construction."""
    return _induced(vpipe(spark, sf, **MESSAGES)).select("cluster_key", "canon", "template")


@query("apply_decisions", with_pipeline("""
SELECT c.cluster_key, c.canon, c.canon AS template FROM clusters c JOIN prof p USING (cluster_key) WHERE p.path = 'single'
UNION ALL SELECT wc.cluster_key, canon, CASE WHEN all_decided THEN asm_template WHEN coalesce(d.template, '') <> '' THEN d.template
 ELSE wcontent END AS template FROM wc LEFT JOIN dec_t d USING (cluster_key)
UNION ALL SELECT c.cluster_key, c.canon, CASE WHEN d.template <> '' THEN d.template ELSE c.canon END AS template
 FROM clusters c JOIN prof p USING (cluster_key) JOIN dec_t d USING (cluster_key) WHERE p.path = 'mixed'""", [
    ("dec_t", "SELECT cluster_key, CASE WHEN count(*) % 3 = 0 THEN arg_min(canon, min_line) ELSE '' END AS template "
              "FROM clusters GROUP BY cluster_key")], **MESSAGES))
def q_apply_decisions(spark, sf):
    """A non-empty decision names the cluster's template; empty -> I11."""
    return _induced(vpipe(spark, sf, **MESSAGES), decisions=True).select("cluster_key", "canon", "template")


@query("template_catalog", with_pipeline(f"""
SELECT md5(template) AS template_key, template, CAST(sum(n) AS BIGINT) AS n_lines, CAST(count(*) AS BIGINT) AS n_contents,
 CAST(min(min_line) AS BIGINT) AS first_line FROM (SELECT i.template, c.n, c.min_line FROM ({_INDUCE_SAME_SQL}) i
 JOIN clusters c USING (cluster_key, canon)) GROUP BY template"""))
def q_template_catalog(spark, sf):
    """I14 over the induced templates."""
    return induction.template_catalog(_induced(vpipe(spark, sf))).select("template_key", "template", *_bigint("n_lines", "n_contents", "first_line"))


def _turns(spark, sf):
    """Conversation turns with a line number of their own, in the order of conversations and turns."""
    conv = tables.read_table(spark, sf, "conversations")
    turns = (conv.agg(F.max("turn")).first()[0] or 0) + 1
    return conv.withColumn("line_id", F.col("conv_id") * turns + F.col("turn"))


@query("align_template")
def q_align_template(spark, sf):
    """Conversation turns grouped by role form mixed-length clusters; the
    first text of each length is aligned (rows-checked)."""
    clusters = _turns(spark, sf).select(F.col("role").alias("cluster_key"), tk.tokenize_expr("text").alias("tokens"),
                                        F.col("line_id").alias("min_line"))
    return induction.align_templates(clusters)


# ---------------------------------------------------------------- mining ---
def _mine(spark, sf, view="events"):
    from .mine import mine_templates
    lines = {"events": tables.events_log, "orders": tables.orders_log, "lineitem": tables.lineitem_log}[view](spark, sf)
    return mine_templates(lines)


@query("mine_templates", EVENTS_CATALOG_SQL)
def q_mine_templates(spark, sf):
    """The full miner with the default mask chain; the template catalog."""
    return _mine(spark, sf).catalog


@query("line_templates", f"SELECT CAST(event_id AS BIGINT) AS line_id, md5(template) AS event_id, template FROM "
                         f"(SELECT event_id, {EVENTS_TEMPLATE_SQL} AS template FROM events)")
def q_line_templates(spark, sf):
    """One (line_id, event_id, template) per line."""
    from .mine import line_templates
    return line_templates(_mine(spark, sf))


_PERFECT = "1.0::DOUBLE"


@query("events_quality", "SELECT " + ", ".join(f"{_PERFECT} AS {c}" for c in ("ga", "pga", "rga", "fga", "pa", "pta", "rta", "fta")) +
       ", CAST(count(DISTINCT event_type) AS BIGINT) AS n_templates, CAST(count(DISTINCT event_type) AS BIGINT) AS n_truth, "
       "CAST(count(*) AS BIGINT) AS n_lines FROM events")
def q_events_quality(spark, sf):
    """E1-E5 of the full miner against the true events templates."""
    from .mine import line_templates
    return metrics.score(line_templates(_mine(spark, sf)), tables.events_truth(spark, sf))


@query("orders_templates", """SELECT md5(template) AS template_key, template, CAST(count(*) AS BIGINT) AS n_lines,
 CAST(1 AS BIGINT) AS n_contents, CAST(min(o_orderkey) AS BIGINT) AS first_line
 FROM (SELECT o_orderkey, concat('Order <*> for customer <*> status ', o_orderstatus) AS template FROM orders) GROUP BY template""")
def q_orders_templates(spark, sf):
    return _mine(spark, sf, "orders").catalog


@query("lineitem_templates", """SELECT md5(template) AS template_key, template, CAST(count(*) AS BIGINT) AS n_lines, CAST(1 AS BIGINT) AS n_contents
 FROM (SELECT concat('Shipped <*> units of part <*> from supplier <*> flag ', l_returnflag, ' state ', l_linestatus) AS template FROM lineitem)
 GROUP BY template""")
def q_lineitem_templates(spark, sf):
    """Volume run: the full miner over every lineitem row (its line ids follow the scan, so they are not returned)."""
    return _mine(spark, sf, "lineitem").catalog.drop("first_line")


# -------------------------------------------------------- match and merge ---
def _induced_catalog(v):
    return induction.template_catalog(_induced(v))


_K_PAD = 9  # oracle only: DuckDB reads at most 9 groups with constant numbers, so patterns are padded to 9


def _h1_duck(content: str, template: str) -> str:
    """DuckDB text of the H1 predicate pieces: (pattern, k, captures list)."""
    pat = (f"'^' || array_to_string(list_transform(string_split({template}, '<*>'), lambda p: "
           f"regexp_replace(p, '([\\\\.^$|?*+()\\[\\]{{}}])', '\\\\\\1', 'g')), '(.*?)') || '$'")
    return pat


def _h1_oracle(pairs_sql: str, content: str, template: str, ids: str) -> str:
    caps = ", ".join(f"regexp_extract({content}, _pat || repeat('()', {_K_PAD} - _k), {i})" for i in range(1, _K_PAD + 1))
    return f"""
h1p AS MATERIALIZED (SELECT *, {_h1_duck(content, template)} AS _pat, len(string_split({template}, '<*>')) - 1 AS _k FROM ({pairs_sql})
 WHERE starts_with({content}, string_split({template}, '<*>')[1])),
h1m AS MATERIALIZED (SELECT * FROM h1p WHERE regexp_matches({content}, _pat)),
h1v AS (SELECT {ids}, unnest([{caps}][1:_k]) AS v FROM h1m),
h1c AS (SELECT {ids}, unnest(string_split_regex(v, '\\s+')) AS tok FROM h1v),
h1bad AS (SELECT DISTINCT {ids} FROM h1c WHERE tok <> '' AND (regexp_matches(tok, '^\\p{{L}}+$') OR tok IN (',', '.', ';', ':'))
          AND tok IN (SELECT token FROM vocab)),
h1 AS (SELECT * FROM h1m WHERE ({ids}) NOT IN (SELECT ({ids}) FROM h1bad))"""


_CAT_SQL = (f"SELECT md5(template) AS template_key, template FROM (SELECT DISTINCT template FROM ({_INDUCE_SAME_SQL}))")


@query("template_match")
def q_template_match(spark, sf):
    """H1 for every (content, induced template) pair of the events pipeline."""
    v = vpipe(spark, sf)
    cat = _induced_catalog(v).checkpoint()
    pairs = matching.candidates(v.cc.select("canon", "tokens"), cat, v.vocab)
    return matching.template_match(pairs, v.vocab, content_col="canon", id_cols=("canon", "template")).select("canon", "template")


def _fix_h1_oracle():
    body = _h1_oracle("SELECT * FROM pairs", "canon", "template", "canon, template")
    ctes = [("cat", _CAT_SQL), ("pairs", "SELECT c.canon, t.template FROM cc c, cat t")]
    sql = with_pipeline("SELECT canon, template FROM h1", ctes)
    return sql.replace("\nSELECT canon, template FROM h1", "," + body + "\nSELECT canon, template FROM h1")


ORACLES["template_match"] = _fix_h1_oracle()


_CATALOG_SQL = (f"SELECT md5(template) AS template_key, template, CAST(sum(n) AS BIGINT) AS n_lines, "
                f"CAST(min(min_line) AS BIGINT) AS first_line FROM (SELECT i.template, c.n, c.min_line FROM ({_INDUCE_SAME_SQL}) i "
                f"JOIN clusters c USING (cluster_key, canon)) GROUP BY template")


def _match_oracle(select):
    body = _h1_oracle("SELECT c.canon, t.template_key, t.template, t.n_lines, t.first_line FROM cc c, catf t",
                      "canon", "template", "canon, template_key")
    sql = with_pipeline(select, [("catf", _CATALOG_SQL)])
    ranked = (",\nmc AS (SELECT canon, template_key, template FROM (SELECT *, row_number() OVER (PARTITION BY canon "
              "ORDER BY n_lines DESC, first_line ASC, template_key) AS r FROM h1) WHERE r = 1)")
    return sql.replace("\n" + select, "," + body + ranked + "\n" + select)


@query("match_catalog")
def q_match_catalog(spark, sf):
    """H2: event contents matched against the induced event templates."""
    v = vpipe(spark, sf)
    cat = _induced_catalog(v)
    return matching.match_catalog(v.cc.select("canon", "tokens"), cat, v.vocab)


ORACLES["match_catalog"] = _match_oracle("SELECT canon, template_key, template FROM mc")


@query("unmatched_lines", _match_oracle("SELECT canon, CAST(n AS BIGINT) AS n FROM cc WHERE canon NOT IN (SELECT canon FROM mc)"))
def q_unmatched_lines(spark, sf):
    """H3: event contents no induced template answers."""
    v = vpipe(spark, sf)
    m = matching.match_catalog(v.cc.select("canon", "tokens"), _induced_catalog(v), v.vocab)
    return matching.unmatched(v.cc.select("canon", F.col("n").cast("bigint")), m)


# Contents of parts, half of them with words of the part's name, and templates
# without a whole literal token: starts and ends of tokens, and wildcards alone.
PART_CONTENTS_SQL = """SELECT DISTINCT concat(p_brand, ' ', p_type, ' size=', CAST(p_size AS STRING),
 CASE WHEN p_partkey % 2 = 0 THEN concat(' ', p_name) ELSE '' END) AS canon FROM part"""
PART_TEMPLATES_SQL = """SELECT md5(template) AS template_key, template, CAST(count(*) AS BIGINT) AS n_lines, CAST(min(p_partkey) AS BIGINT) AS first_line FROM (
 SELECT concat(substr(p_brand, 1, 7), '<*>') AS template, p_partkey FROM part
 UNION ALL SELECT concat('<*>#<*>=', CAST(p_size AS STRING)), p_partkey FROM part WHERE p_size % 3 = 0
 UNION ALL SELECT concat('<*> ', substr(p_type, 1, 2), '<*>', substr(p_type, 4, 10), ' <*>'), p_partkey FROM part WHERE p_partkey % 7 = 0
 UNION ALL SELECT '<*> <*> <*>', p_partkey FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT '<*>', p_partkey FROM part WHERE p_partkey % 5 = 0) t GROUP BY template"""


@query("match_parts")
def q_match_parts(spark, sf):
    """H2 with templates that hold no whole literal token, every part against all of them."""
    tables.register_tables(spark, sf, ["part"])
    vocab = spark.sql("SELECT DISTINCT explode(split(p_name, ' ')) AS token FROM part")
    return matching.match_catalog(spark.sql(PART_CONTENTS_SQL), spark.sql(PART_TEMPLATES_SQL), vocab)


ORACLES["match_parts"] = (
    "WITH cc AS (" + PART_CONTENTS_SQL + "), catf AS (" + PART_TEMPLATES_SQL + "), "
    "vocab AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part)," +
    _h1_oracle("SELECT c.canon, t.template_key, t.template, t.n_lines, t.first_line FROM cc c, catf t", "canon", "template", "canon, template_key") +
    "\nSELECT canon, template_key, template FROM (SELECT *, row_number() OVER (PARTITION BY canon "
    "ORDER BY n_lines DESC, first_line ASC, template_key) AS r FROM h1) WHERE r = 1")


def _merge_input(spark, sf):
    """Templates to merge: the events pipeline's per-content templates (I11
    fallback keeps many near-duplicates, which is what X1 is for)."""
    v = vpipe(spark, sf)
    t = v.clusters.select("canon", "n", "min_line")
    return (t.groupBy(F.col("canon").alias("template"))
            .agg(F.sum("n").alias("n_lines"), F.min("min_line").alias("first_line"))
            .withColumn("template_key", F.md5("template")))


@query("mergeable_pairs")
def q_mergeable_pairs(spark, sf):
    """X1 over the distinct contents taken as templates."""
    v = vpipe(spark, sf)
    t = _merge_input(spark, sf)
    p = merging.mergeable_pairs(t, v.vocab)
    names = t.select(F.col("template_key").alias("k"), "template")
    return (p.join(names.withColumnRenamed("k", "a_key").withColumnRenamed("template", "a_template"), "a_key")
            .join(names.withColumnRenamed("k", "b_key").withColumnRenamed("template", "b_template"), "b_key")
            .select("a_template", "b_template"))


def _x1_oracle(select):
    pairs = ("SELECT p.template AS p_template, x.template AS x_template FROM tt2 p JOIN tt2 x "
             "ON abs(len(p.tokens) - len(x.tokens)) BETWEEN 1 AND 2")
    body = _h1_oracle(pairs, "x_template", "p_template", "p_template, x_template")
    extra = [("tpl", "SELECT DISTINCT canon AS template FROM clusters"),
             ("tt2", "SELECT template, string_split(template, ' ') AS tokens FROM tpl")]
    sql = with_pipeline(select, extra)
    x1 = (",\neqp AS (SELECT a.template AS a_template, b.template AS b_template FROM tt2 a JOIN tt2 b "
          "ON len(a.tokens) = len(b.tokens) AND md5(a.template) < md5(b.template) WHERE list_bool_and(list_transform("
          "range(1, len(a.tokens) + 1), lambda i: a.tokens[i] = b.tokens[i] OR a.tokens[i] = '<*>' OR b.tokens[i] = '<*>'))),\n"
          "x1 AS (SELECT * FROM eqp UNION SELECT CASE WHEN md5(p_template) < md5(x_template) THEN p_template ELSE x_template END, "
          "CASE WHEN md5(p_template) < md5(x_template) THEN x_template ELSE p_template END FROM h1)")
    return sql.replace("\n" + select, "," + body + x1 + "\n" + select)


ORACLES["mergeable_pairs"] = _x1_oracle("SELECT a_template, b_template FROM x1")


@query("positional_merge", _x1_oracle(
    "SELECT a_template, b_template, merged FROM (SELECT a_template, b_template, string_split(a_template, ' ') AS a, "
    "string_split(b_template, ' ') AS b, CASE WHEN len(a) = len(b) AND list_bool_and(list_transform(range(1, len(a) + 1), "
    "lambda i: a[i] = b[i] OR a[i] = '<*>' OR b[i] = '<*>')) THEN array_to_string(list_transform(range(1, len(a) + 1), "
    "lambda i: CASE WHEN a[i] = b[i] THEN a[i] ELSE '<*>' END), ' ') END AS merged FROM x1) WHERE merged IS NOT NULL"))
def q_positional_merge(spark, sf):
    """X2 on the equal-length mergeable pairs."""
    return (merging.positional_merge_pairs(q_mergeable_pairs(spark, sf)).where("merged IS NOT NULL")
            .select("a_template", "b_template", "merged"))


@query("merge_templates")
def q_merge_templates(spark, sf):
    """Hub merging to a fixpoint; the alias map old -> new template."""
    v = vpipe(spark, sf)
    return merging.merge_templates(_merge_input(spark, sf), v.vocab)


# ------------------------------------------------------------ similarity ---
BENCH_NODES_SQL = ("SELECT doc_id AS id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS tokens "
                   "FROM documents")


def _bench_nodes(spark, sf):
    """Documents as token lists (they hold exact and near copies)."""
    b = tables.read_table(spark, sf, "documents")
    return b.select(F.col("doc_id").alias("id"), F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("tokens"),
                    F.col("doc_id").alias("min_line"), F.col("doc_id").alias("max_line"))


@query("dynamic_threshold", with_pipeline("SELECT DISTINCT CAST(len(tokens) AS BIGINT) AS n, round(1 - log2(len(tokens)) / len(tokens), 6) AS threshold "
                                          "FROM cc WHERE len(tokens) > 0"))
def q_dynamic_threshold(spark, sf):
    """1 - log2(n)/n for every token count present."""
    cc = vpipe(spark, sf).cc.where(F.size("tokens") > 0)
    return cc.select(F.size("tokens").cast("bigint").alias("n"),
                     F.round(similarity.dynamic_threshold(F.size("tokens")), 6).alias("threshold")).distinct()


_JACC_CTES = f"""nodes AS MATERIALIZED ({BENCH_NODES_SQL}),
tk AS MATERIALIZED (SELECT id, unnest(list_distinct(tokens)) AS t FROM nodes),
sz AS MATERIALIZED (SELECT id, len(list_distinct(tokens)) AS d, len(tokens) AS n FROM nodes),
sc AS MATERIALIZED (SELECT a_id, b_id, c / (x.d + y.d - c) AS score, x.n AS an, y.n AS bn FROM
 (SELECT a.id AS a_id, b.id AS b_id, count(*) AS c FROM tk a JOIN tk b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
 JOIN sz x ON x.id = a_id JOIN sz y ON y.id = b_id)"""
_JACC_DUCK = ("CASE WHEN len(list_distinct(list_concat(a.tokens, b.tokens))) = 0 THEN 0.0 ELSE "
              "len(list_intersect(list_distinct(a.tokens), list_distinct(b.tokens))) / len(list_distinct(list_concat(a.tokens, b.tokens))) END")


@query("jaccard_similarity", f"""WITH {_JACC_CTES}
SELECT CAST(a_id AS BIGINT) AS a_id, CAST(b_id AS BIGINT) AS b_id, round(score, 6) AS score FROM sc WHERE score >= 0.2""")
def q_jaccard_similarity(spark, sf):
    """L3 with a fixed threshold of 0.2 (L6): prefix-filtered pairs."""
    p = similarity.similar_pairs(_bench_nodes(spark, sf), "jaccard", 0.2)
    return p.select(F.col("a_id").cast("bigint"), F.col("b_id").cast("bigint"), F.round("score", 6).alias("score"))


@query("similar_pairs", f"""WITH {_JACC_CTES}
SELECT CAST(a_id AS BIGINT) AS a_id, CAST(b_id AS BIGINT) AS b_id FROM sc WHERE score >= 1 - log2(an) / an OR score >= 1 - log2(bn) / bn""")
def q_similar_pairs(spark, sf):
    """L7 with Jaccard and the dynamic threshold (either orientation)."""
    p = similarity.similar_pairs(_bench_nodes(spark, sf), "jaccard", 0.0)
    return p.select(F.col("a_id").cast("bigint"), F.col("b_id").cast("bigint"))


@query("fixed_threshold", f"""WITH {_JACC_CTES}
SELECT CAST(a_id AS BIGINT) AS a_id, CAST(b_id AS BIGINT) AS b_id FROM sc WHERE score >= 0.3""")
def q_fixed_threshold(spark, sf):
    """Fixed similarity threshold 0.3."""
    p = similarity.similar_pairs(_bench_nodes(spark, sf), "jaccard", 0.3)
    return p.select(F.col("a_id").cast("bigint"), F.col("b_id").cast("bigint"))


_LCS_DUCK = ("list_reduce(a.tokens, lambda prev, x: list_reduce(range(1, len(b.tokens) + 1), lambda cur, j: "
             "list_append(cur, CASE WHEN x = b.tokens[j] THEN prev[j] + 1 ELSE greatest(cur[j], prev[j + 1]) END), [0]), "
             "list_transform(range(0, len(b.tokens) + 1), lambda z: 0))[len(b.tokens) + 1]")


_LCS_SCORE_DUCK = f"""CASE WHEN a.canon = b.canon THEN 1.0
 WHEN instr(CASE WHEN length(a.canon) >= length(b.canon) THEN a.canon ELSE b.canon END,
            CASE WHEN length(a.canon) >= length(b.canon) THEN b.canon ELSE a.canon END) > 0 THEN 1.0
 WHEN abs(len(a.tokens) - len(b.tokens)) > least(len(a.tokens), len(b.tokens)) THEN 0.0
 ELSE {_LCS_DUCK} / least(len(a.tokens), len(b.tokens)) END"""


@query("lcs_similarity", with_pipeline(f"""
SELECT a_canon, b_canon, round(score, 6) AS score FROM (
 SELECT a.canon AS a_canon, b.canon AS b_canon, {_LCS_SCORE_DUCK} AS score, a.tokens AS ta, b.tokens AS tb,
  a.min_line AS amin, a.max_line AS amax, b.min_line AS bmin, b.max_line AS bmax
 FROM cc a JOIN cc b ON a.canon < b.canon WHERE len(a.tokens) > 0 AND len(b.tokens) > 0)
WHERE (amin < bmax AND score >= 1 - log2(len(ta)) / len(ta)) OR (bmin < amax AND score >= 1 - log2(len(tb)) / len(tb))"""))
def q_lcs_similarity(spark, sf):
    """LCS similar pairs (dynamic threshold) among the distinct
    event contents, from prefix-filtered and substring candidates; the
    oracle brute-forces every pair."""
    cc = vpipe(spark, sf).cc
    nodes = cc.select(F.col("canon").alias("id"), "tokens", "min_line", "max_line")
    p = similarity.similar_pairs(nodes, "lcs", 0.0)
    return p.select(F.col("a_id").alias("a_canon"), F.col("b_id").alias("b_canon"), F.round("score", 6).alias("score"))


@query("similarity_components", with_pipeline("SELECT id AS canon, c AS component FROM r", [
    ("e", f"""SELECT a_canon AS s, b_canon AS d FROM (
 SELECT a.canon AS a_canon, b.canon AS b_canon, {_LCS_SCORE_DUCK} AS score, a.tokens AS ta, b.tokens AS tb,
  a.min_line AS amin, a.max_line AS amax, b.min_line AS bmin, b.max_line AS bmax
 FROM cc a JOIN cc b ON a.canon < b.canon WHERE len(a.tokens) > 0 AND len(b.tokens) > 0)
WHERE (amin < bmax AND score >= 1 - log2(len(ta)) / len(ta)) OR (bmin < amax AND score >= 1 - log2(len(tb)) / len(tb))"""),
    ("u", "SELECT s, d FROM e UNION ALL SELECT d, s FROM e")]).replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "\nSELECT id AS canon", """,
r(id, c) USING KEY (id) AS (SELECT canon, canon FROM cc WHERE len(tokens) > 0
 UNION SELECT u.s, min(x.c) FROM r x JOIN u ON x.id = u.d JOIN recurring.r y ON y.id = u.s WHERE x.c < y.c GROUP BY u.s)
SELECT id AS canon"""))
def q_similarity_components(spark, sf):
    """L7 + L8 over the distinct event contents: components from the forests of
    the buckets; the oracle links every similar pair."""
    from ..operators.forests import linked_components
    cc = vpipe(spark, sf).cc.where(F.size("tokens") > 0)
    return linked_components(cc.select(F.col("canon").alias("id"), "tokens", "min_line", "max_line")).select(
        F.col("id").alias("canon"), "component")


@query("cosine_similarity", f"""WITH nodes AS MATERIALIZED ({BENCH_NODES_SQL}),
tc AS MATERIALIZED (SELECT id, t, count(*) AS c FROM (SELECT id, unnest(tokens) AS t FROM nodes) GROUP BY id, t),
nm AS MATERIALIZED (SELECT id, sqrt(sum(c * c)) AS n FROM tc GROUP BY id),
dots AS (SELECT a.id AS a_id, b.id AS b_id, sum(a.c * b.c) AS dot FROM tc a JOIN tc b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
SELECT CAST(a_id AS BIGINT) AS a_id, CAST(b_id AS BIGINT) AS b_id, round(dot / (x.n * y.n), 6) AS score
FROM dots JOIN nm x ON x.id = a_id JOIN nm y ON y.id = b_id WHERE dot / (x.n * y.n) >= 0.97""")
def q_cosine_similarity(spark, sf):
    """L4 (extension, real token-count cosine): pairs of documents at 0.97 or more."""
    p = similarity.similar_pairs(_bench_nodes(spark, sf), "cosine", 0.97)
    return p.select(F.col("a_id").cast("bigint"), F.col("b_id").cast("bigint"), F.round("score", 6).alias("score"))


@query("components", f"""WITH RECURSIVE {_JACC_CTES},
e AS MATERIALIZED (SELECT a_id AS s, b_id AS d FROM sc WHERE score >= 0.2),
u AS MATERIALIZED (SELECT s, d FROM e UNION SELECT d, s FROM e UNION SELECT id, id FROM nodes),
r(id, c) AS (SELECT s, d FROM u UNION SELECT r.id, u.d FROM r JOIN u ON r.c = u.s)
SELECT CAST(id AS BIGINT) AS id, CAST(min(c) AS BIGINT) AS component FROM r GROUP BY id""")
def q_components(spark, sf):
    """L8 over the Jaccard >= 0.2 graph of the documents."""
    nodes = _bench_nodes(spark, sf)
    e = similarity.similar_pairs(nodes, "jaccard", 0.2).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    return similarity.components(nodes, e).select(F.col("id").cast("bigint"), F.col("component").cast("bigint"))


@query("similarity_clusters")
def q_similarity_clusters(spark, sf):
    """G3 -> L7 -> L8 on conversation turns (rows-checked)."""
    from .mine import cluster_contents
    from ..operators.tokens import build_vocabulary, canonical_contents, materialize_vocab, with_tokens
    lines = _turns(spark, sf).select("line_id", F.col("text").alias("line"))
    cc = with_tokens(written(canonical_contents(distinct_contents(preprocess(lines))).drop("tokens")))
    vocab = materialize_vocab(build_vocabulary(cc, min_df=50))
    return cluster_contents(cc, vocab).groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n_contents"))


# ---------------------------------------------------------------- params ---
_PARAM_RE_DUCK = ("'^' || array_to_string(list_transform(string_split(template, '<*>'), lambda p: replace(regexp_replace(p, "
                  "'([\\\\.^$|?*+()\\[\\]{}])', '\\\\\\1', 'g'), ' ', '\\s+')), '(.+?)') || '$'")


@query("param_regex", with_pipeline(f"SELECT template, {_PARAM_RE_DUCK} AS regex FROM (SELECT DISTINCT template FROM ({_INDUCE_SAME_SQL}))"))
def q_param_regex(spark, sf):
    """O1 for every induced template."""
    t = _induced(vpipe(spark, sf)).select("template").distinct()
    return t.select("template", params.param_regex(F.col("template")).alias("regex"))


_PARAM_LINES_SQL = (f"SELECT m.line_id, i.template, array_to_string({tk.tokenize_sql(D, 'l.line')}, ' ') AS text "
                    f"FROM masked m JOIN lines l USING (line_id) JOIN tok t ON t.content = m.content "
                    f"JOIN ({_INDUCE_SAME_SQL}) i ON i.canon = array_to_string(t.tokens, ' ')")


def _param_lines(spark, sf):
    v = vpipe(spark, sf)
    ind = _induced(v).select("canon", "template")
    canon_of = v.dm.select("content", F.array_join(tk.tokenize_expr("content"), " ").alias("canon"))
    return (v.masked.select("line_id", "content").join(canon_of, "content").join(ind, "canon")
            .join(v.lines.select("line_id", "line"), "line_id")
            .select("line_id", "template", F.array_join(tk.tokenize_expr("line"), " ").alias("text")))


def _params_oracle(select):
    caps = ", ".join(f"regexp_extract(text, _pat || repeat('()', {_K_PAD} - _k), {i})" for i in range(1, _K_PAD + 1))
    return with_pipeline(select, [
        ("pl", _PARAM_LINES_SQL),
        ("plp", f"SELECT *, {_PARAM_RE_DUCK} AS _pat, len(string_split(template, '<*>')) - 1 AS _k FROM pl"),
        ("plm", "SELECT * FROM plp WHERE _k > 0 AND regexp_matches(text, _pat)"),
        ("params", f"SELECT line_id, template, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS position, unnest(v) AS value "
                   f"FROM (SELECT line_id, template, [{caps}][1:_k] AS v FROM plm)")])


@query("extract_params", _params_oracle("SELECT CAST(line_id AS BIGINT) AS line_id, template, position, value, '*' AS mask_name FROM params"))
def q_extract_params(spark, sf):
    """O2: parameters of every event line from its template's regex, applied
    to the tokenized raw line."""
    p = params.extract_params(_param_lines(spark, sf))
    return p.select(F.col("line_id").cast("bigint"), "template", "position", "value", "mask_name")


_VALUES_SQL = """SELECT CAST(event_id AS BIGINT) AS line_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS position, unnest(v) AS value,
 unnest(m) AS mask_name FROM (SELECT event_id, CASE event_type
 WHEN 'click' THEN [CAST(user_id AS VARCHAR), concat('10.0.', event_id % 250, '.', user_id % 250, ':8080')]
 WHEN 'view' THEN [concat('/page/', user_id, '/', event_id), CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)]
 WHEN 'signup' THEN [CAST(user_id AS VARCHAR), CAST(event_id % 7 AS VARCHAR)]
 WHEN 'purchase' THEN [CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), CAST(event_id AS VARCHAR)]
 ELSE [CAST(event_id AS VARCHAR), CAST(user_id % 9 AS VARCHAR)] END AS v,
 CASE event_type WHEN 'click' THEN ['NUM', 'HOSTPORT'] WHEN 'view' THEN ['PATH', 'NUM'] ELSE ['NUM', 'NUM'] END AS m FROM events)"""


def _named_params(spark, sf, exact):
    lines = tables.events_log(spark, sf).select("line_id", F.col("line").alias("text"))
    masked = mask_lines(lines, NAMED_RULES, text_col="text", out_col="template")
    p = params.extract_params(masked, exact=exact, rules=NAMED_RULES)
    return p.select(F.col("line_id").cast("bigint").alias("line_id"), "position", "value", "mask_name")


@query("named_params", _VALUES_SQL)
def q_named_params(spark, sf):
    """O2 with named masks: every value with the name of its mask; the oracle reads the columns that the lines were rendered from."""
    return _named_params(spark, sf, exact=False)


@query("named_params_exact", _VALUES_SQL)
def q_named_params_exact(spark, sf):
    """O1/O2 in exact mode: a slot takes only what its own rules match."""
    return _named_params(spark, sf, exact=True)


@query("param_profile", _params_oracle("""
SELECT a.template, a.position, a.n_values, a.n_distinct, t.value AS top_value, t.c AS top_count FROM
 (SELECT template, position, CAST(sum(c) AS BIGINT) AS n_values, CAST(count(*) AS BIGINT) AS n_distinct FROM
   (SELECT template, position, value, count(*) AS c FROM params GROUP BY ALL) GROUP BY ALL) a
 JOIN (SELECT template, position, value, c FROM (SELECT *, row_number() OVER (PARTITION BY template, position ORDER BY c DESC, value) AS r
   FROM (SELECT template, position, value, count(*) AS c FROM params GROUP BY ALL)) WHERE r = 1) t USING (template, position)"""))
def q_param_profile(spark, sf):
    """O3: values, exact distinct values and top value per template slot."""
    prof = params.param_profile(params.extract_params(_param_lines(spark, sf)))
    return prof.select("template", "position", "n_values", "n_distinct", "top_value", F.col("top_count").cast("bigint"))


@query("param_top_k", _params_oracle("""SELECT template, position, CAST(r AS BIGINT) AS rank, value, CAST(c AS BIGINT) AS n FROM
 (SELECT *, row_number() OVER (PARTITION BY template, position ORDER BY c DESC, value) AS r
  FROM (SELECT template, position, value, count(*) AS c FROM params GROUP BY ALL)) WHERE r <= 3"""))
def q_param_top_k(spark, sf):
    """O3: the three most frequent values of every slot."""
    top = params.top_values(params.extract_params(_param_lines(spark, sf)), 3)
    return top.select("template", *_bigint("position", "rank"), "value", *_bigint("n"))


@query("param_sketches", _params_oracle("SELECT template, position, CAST(count(*) AS BIGINT) AS n_values, true AS distinct_close FROM params GROUP BY ALL"))
def q_param_sketches(spark, sf):
    """O3 from sketches kept per batch (here four) and added up; the estimate must be within 8 % (five standard errors) of the exact count."""
    p = written(params.extract_params(_param_lines(spark, sf))).withColumn("batch", F.pmod("line_id", F.lit(4)))
    found = params.sketch_profile(params.merge_sketches(params.param_sketches(p, by=("batch",))))
    exact = p.groupBy("template", "position", "value").count().groupBy("template", "position").agg(F.count(F.lit(1)).alias("exact"))
    return found.join(exact, ["template", "position"]).select(
        "template", *_bigint("position", "n_values"), (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.08 * F.col("exact")).alias("distinct_close"))


# --------------------------------------------------------------- metrics ---
_PRED_SQL = "SELECT m.line_id, k.static_key AS event_id, k.canon AS template FROM masked m JOIN tok t USING (content) JOIN keyed k ON k.canon = array_to_string(t.tokens, ' ')"


def _pred(v):
    """A data-derived prediction: group = static key, template = canonical text."""
    canon_of = v.dm.select("content", F.array_join(tk.tokenize_expr("content"), " ").alias("canon"))
    return (v.masked.select("line_id", "content").join(canon_of, "content").join(v.keyed.select("canon", "static_key"), "canon")
            .select("line_id", F.col("static_key").alias("event_id"), F.col("canon").alias("template")))


_CONT_SQL = """
cont AS (SELECT p.event_id AS pid, t.event_id AS tid, count(*) AS c FROM pred p JOIN truth t USING (line_id) GROUP BY ALL),
ptab AS (SELECT event_id AS pid, count(*) AS psz, arg_max(template, line_id) AS ptemplate FROM pred GROUP BY ALL),
ttab AS (SELECT event_id AS tid, count(*) AS tsz, arg_min(template, line_id) AS ttemplate FROM truth GROUP BY ALL),
cx AS (SELECT cont.*, count(*) OVER (PARTITION BY pid) AS n_tid, psz, ptemplate, tsz, ttemplate FROM cont JOIN ptab USING (pid) JOIN ttab USING (tid)),
cy AS (SELECT *, (n_tid = 1 AND psz = tsz) AS group_match,
  regexp_replace(ptemplate, '\\s+', '', 'g') = regexp_replace(regexp_replace(ttemplate, '(<\\*>[\\s]*){2,}', '<*> ', 'g'), '\\s+', '', 'g') AS template_match FROM cx)"""


SCORE_SELECT = """
SELECT ga, pga, rga, CASE WHEN pga + rga > 0 THEN round(2 * pga * rga / (pga + rga), 4) ELSE 0.0 END AS fga,
 pa, pta, rta, CASE WHEN pta + rta > 0 THEN round(2 * pta * rta / (pta + rta), 4) ELSE 0.0 END AS fta, n_templates, n_truth, n_lines FROM (
SELECT round(ga_cnt / n_lines, 4) AS ga, round(tp / n_pred, 4) AS pga, round(tp / n_truth, 4) AS rga, round(pa_cnt / n_lines, 4) AS pa,
 round(ta / n_pred, 4) AS pta, round(ta / n_truth, 4) AS rta, CAST(n_pred AS BIGINT) AS n_templates, CAST(n_truth AS BIGINT) AS n_truth,
 CAST(n_lines AS BIGINT) AS n_lines FROM (
 SELECT sum(CASE WHEN group_match THEN c ELSE 0 END) AS ga_cnt, sum(CASE WHEN template_match THEN c ELSE 0 END) AS pa_cnt,
  sum(CASE WHEN group_match THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN group_match AND template_match THEN 1 ELSE 0 END) AS ta,
  count(DISTINCT pid) AS n_pred, sum(c) AS n_lines, (SELECT count(DISTINCT event_id) FROM truth) AS n_truth FROM cy))"""


@query("score")
def q_score(spark, sf):
    """GA, PGA, RGA, FGA, PA, PTA, RTA, FTA of a data-derived prediction."""
    v = vpipe(spark, sf, **MESSAGES)
    return metrics.score(_pred(v), v.truth)


def _with_cont(select):
    sql = with_pipeline(select, [("pred", _PRED_SQL)], **MESSAGES)
    return sql.replace("\n" + select, "," + _CONT_SQL + "\n" + select)


ORACLES["score"] = _with_cont(SCORE_SELECT)


@query("grouping_accuracy", _with_cont("SELECT pid, tid, CAST(c AS BIGINT) AS c, CAST(psz AS BIGINT) AS psz, CAST(tsz AS BIGINT) AS tsz, "
                                       "CAST(n_tid AS BIGINT) AS n_tid, group_match FROM cy"))
def q_grouping_accuracy(spark, sf):
    """E1 detail: the contingency rows and which count toward GA."""
    v = vpipe(spark, sf, **MESSAGES)
    g = metrics.grouping_accuracy(_pred(v), v.truth)
    return g.select("pid", "tid", *_bigint("c", "psz", "tsz", "n_tid"), "group_match")


@query("template_equal", _with_cont("SELECT DISTINCT ptemplate, ttemplate, template_match FROM cy"))
def q_template_equal(spark, sf):
    """E3 for every (predicted, true) template pair that shares lines."""
    v = vpipe(spark, sf, **MESSAGES)
    c = metrics.contingency(_pred(v), v.truth)
    return c.select("ptemplate", "ttemplate", "template_match").distinct()


@query("missed_lines", _with_cont("""SELECT t.event_id AS tid, c.pid, CAST(t.line_id AS BIGINT) AS line_id FROM truth t
 JOIN (SELECT pid, tid FROM cy WHERE n_tid = 1 AND NOT group_match) c ON c.tid = t.event_id
 WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.line_id = t.line_id AND p.event_id = c.pid)"""))
def q_missed_lines(spark, sf):
    """Lines of a split true group outside the pure predicted group."""
    v = vpipe(spark, sf, **MESSAGES)
    m = metrics.missed_lines(_pred(v), v.truth)
    return m.select("tid", "pid", F.col("line_id").cast("bigint"))


@query("occurrence", with_pipeline("SELECT event_id, template, CAST(count(*) AS BIGINT) AS occurrence FROM truth GROUP BY ALL"))
def q_occurrence(spark, sf):
    """Lines per true template."""
    return metrics.occurrence(vpipe(spark, sf).truth).withColumn("occurrence", F.col("occurrence").cast("bigint"))


@query("run_summary", f"SELECT 'events' AS dataset, {_PERFECT} AS ga, {_PERFECT} AS pa, {_PERFECT} AS fga, {_PERFECT} AS fta, "
                      "CAST(count(*) AS BIGINT) AS n_lines, CAST(count(DISTINCT event_type) AS BIGINT) AS n_templates FROM events")
def q_run_summary(spark, sf):
    """E7 without timings: the summary row of the full events run."""
    from .mine import line_templates
    s = metrics.score(line_templates(_mine(spark, sf)), tables.events_truth(spark, sf))
    return runs.run_summary("events", s)


# ------------------------------------------------------------- streaming ---
@query("stream_mine", f"SELECT template_key, template, n_lines, first_line FROM ({EVENTS_CATALOG_SQL})")
def q_stream_mine(spark, sf):
    """events_log replayed as a file stream in two chunks; final catalog."""
    from ..streaming.incremental import replay_stream
    return replay_stream(spark, tables.events_log(spark, sf), chunks=2)


@query("stream_queue", ORACLES["arbitration_queue"])
def q_stream_queue(spark, sf):
    """I8 in the stream: the questions of a batch with all lines of the messages view, as its sink holds them."""
    from ..streaming.incremental import read_queue, replay
    v = vpipe(spark, sf, **MESSAGES)
    state = replay(spark, v.lines, chunks=1, vocab=v.vocab, regex=EVENTS_REGEX, rules=[])
    return read_queue(spark, state).drop("batch")


# batch -> aliases written in it: F is merged in batch 1, created again, merged in
# batch 2 elsewhere; batch 3 merges O into F and what F became back into F.
ALIASES = [(1, "F", "A"), (1, "P", "B"), (2, "F", "C"), (2, "A", "C"), (3, "C", "F"), (3, "O", "F"), (4, "B", "P")]
_BATCH = "o_orderkey % 5"


def _alias_oracle() -> str:
    """Folds the batches one after the other over every line assigned up to then."""
    rows = ", ".join(f"({b}, '{o}', '{n}')" for b, o, n in ALIASES)
    cur = f"SELECT CAST(o_orderkey AS BIGINT) AS line_id, {_BATCH} AS b, o_orderstatus AS k FROM orders"
    for i in sorted({b for b, *_ in ALIASES}):
        cur = (f"SELECT line_id, b, CASE WHEN b <= {i} THEN coalesce(n, k) ELSE k END AS k FROM ({cur}) c "
               f"LEFT JOIN (SELECT o, n FROM al WHERE ab = {i}) x ON x.o = c.k")
    return f"WITH al AS (SELECT * FROM (VALUES {rows}) AS v(ab, o, n)) SELECT line_id, k AS template_key FROM ({cur})"


@query("resolve_alias", _alias_oracle())
def q_resolve_alias(spark, sf):
    """Z3: assignments of five batches through aliases written in batch order."""
    from ..streaming.incremental import resolve_alias
    orders = tables.read_table(spark, sf, "orders")
    alias = spark.createDataFrame(ALIASES, "batch long, old_key string, new_key string")
    assign = orders.select(F.col("o_orderkey").cast("bigint").alias("line_id"), F.col("o_orderstatus").alias("template_key"),
                           F.expr(_BATCH).cast("bigint").alias("batch"))
    return resolve_alias(assign, alias)
