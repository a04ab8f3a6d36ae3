"""DuckDB SQL for the correctness oracle.

The value-checked queries run the events pipeline with RE2-compatible
dataset regexes.  This module spells the same pipeline as DuckDB CTEs; the
tokenizer and preprocessing text come from the shared expression builders,
everything after (token classes, keys, entropy, decisions, metrics) is
written here independently of the Spark code.
"""

from __future__ import annotations

from ..functions.masking import preprocess_sql
from ..functions.sqlexpr import DUCK as D
from ..functions.tokenizer import tokenize_sql
from ..operators.tokens import CAMEL_PART_RE, CAMEL_RE, NON_UPPER_LETTER, SCOPED_RE, SNAKE_RE
from ..sources.tables import EVENTS_LOG_SQL, TRUTH_VALUES_SQL
from .settings import EVENTS_REGEX


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pipeline_ctes(lines_sql: str = EVENTS_LOG_SQL, regex=EVENTS_REGEX, truth_sql: str = TRUTH_VALUES_SQL) -> list[tuple[str, str]]:
    return [
        ("lines", lines_sql),
        ("masked", f"SELECT line_id, event_id, {preprocess_sql(D, 'line', regex=regex)} AS content FROM lines"),
        ("dm", "SELECT content, count(*) AS n, min(line_id) AS min_line, max(line_id) AS max_line FROM masked GROUP BY content"),
        ("tok", f"SELECT content, n, min_line, max_line, {tokenize_sql(D, 'content')} AS tokens FROM dm"),
        ("cc", "SELECT array_to_string(tokens, ' ') AS canon, first(tokens) AS tokens, CAST(sum(n) AS BIGINT) AS n, "
               "min(min_line) AS min_line, max(max_line) AS max_line FROM tok GROUP BY 1"),
        ("vocab", "SELECT token FROM (SELECT n, unnest(list_distinct(tokens)) AS token FROM cc) "
                  "WHERE regexp_matches(token, '^\\p{L}+$') GROUP BY token HAVING sum(n) >= 2 "
                  "UNION SELECT unnest([',', '.', ';', ':']) AS token"),
        ("tt", "SELECT *, tokens[i] AS token, CAST(i - 1 AS BIGINT) AS pos FROM "
               "(SELECT canon, n, min_line, tokens, len(tokens) AS len, unnest(range(1, len(tokens) + 1)) AS i FROM cc)"),
        ("dt", "SELECT DISTINCT token FROM tt"),
        ("camel", f"SELECT DISTINCT token, true AS camel_ok FROM (SELECT token, unnest(parts) AS part FROM "
                  f"(SELECT token, regexp_extract_all(token, {_q(CAMEL_PART_RE)}) AS parts FROM dt "
                  f"WHERE regexp_matches(token, {_q(CAMEL_RE)})) WHERE len(parts) >= 2) "
                  f"WHERE length(part) > 1 AND NOT regexp_matches(part, '\\p{{Nd}}') AND part IN (SELECT token FROM vocab)"),
        ("flags", "SELECT dt.token, (v.token IS NOT NULL) AS is_vocab, coalesce(c.camel_ok, false) AS camel_ok "
                  "FROM dt LEFT JOIN vocab v ON dt.token = v.token LEFT JOIN camel c ON dt.token = c.token"),
        ("st", "SELECT tt.*, f.is_vocab, f.camel_ok, CASE WHEN pos > 0 THEN tokens[pos] END AS prev, "
               "CASE WHEN pos + 1 < len THEN tokens[pos + 2] END AS nxt, "
               "CASE WHEN pos = 0 THEN tokens[len] ELSE tokens[pos] END AS prev_wrap FROM tt JOIN flags f USING (token)"),
        ("st2", "SELECT *, CASE "
                "WHEN is_vocab AND (pos = 0 OR coalesce(prev NOT IN ('=', ':', 'for', 'user', 'to'), true)) "
                "AND token NOT IN ('true', 'false') THEN true "
                f"WHEN token <> '<*>' AND NOT regexp_matches(token, '\\p{{Nd}}') AND NOT regexp_matches(token, {_q(NON_UPPER_LETTER)}) "
                "THEN NOT ((pos > 0 AND pos < len - 1 AND prev IN ('=', ':') AND nxt = ',') OR (pos = len - 1 AND prev_wrap = '=')) "
                f"ELSE ((pos = 0 AND regexp_matches(token, {_q(SNAKE_RE)})) OR camel_ok OR regexp_matches(token, {_q(SCOPED_RE)}) "
                "OR (pos > 0 AND pos < len - 1 AND is_vocab AND coalesce(nxt IN ('=', ':'), false))) END AS is_static FROM st"),
        ("keys", "SELECT canon, string_agg(CAST(pos AS VARCHAR) || token, '' ORDER BY pos) AS static_key "
                 "FROM st2 WHERE is_static GROUP BY canon"),
        ("keyed", "SELECT cc.*, coalesce(k.static_key, '<*>') AS static_key FROM cc LEFT JOIN keys k USING (canon)"),
        ("clusters", "SELECT static_key AS cluster_key, canon, tokens, n, min_line, max_line FROM keyed WHERE static_key <> '<*>'"),
        ("prof", "SELECT cluster_key, count(*) AS n_contents, CAST(sum(n) AS BIGINT) AS n_lines, min(len(tokens)) AS min_len, "
                 "max(len(tokens)) AS max_len, min(min_line) AS first_line, "
                 "CASE WHEN count(*) = 1 THEN 'single' WHEN min(len(tokens)) <> max(len(tokens)) THEN 'mixed' ELSE 'same' END AS path "
                 "FROM clusters GROUP BY cluster_key"),
        ("same", "SELECT c.* FROM clusters c JOIN prof p USING (cluster_key) WHERE p.path = 'same'"),
        ("ptc", "SELECT cluster_key, pos, token, sum(n) AS cnt, min(min_line) AS first_seen FROM "
                "(SELECT s.cluster_key, s.n, s.min_line, u.i - 1 AS pos, s.tokens[u.i] AS token FROM same s, "
                "LATERAL (SELECT unnest(range(1, len(s.tokens) + 1)) AS i) u) GROUP BY ALL"),
        ("ptcv", "SELECT p.*, (v.token IS NOT NULL) AS is_vocab FROM ptc p LEFT JOIN vocab v USING (token)"),
        ("col", "SELECT cluster_key, pos, count(*) AS n_tok, bool_or(token = '<*>') AS has_wild, sum(cnt) AS tot, "
                "sum(cnt * log2(cnt)) AS slog, bool_or(NOT is_vocab) AS any_nonvocab, arg_min(token, first_seen) AS tok0, "
                "arg_min(is_vocab, first_seen) AS tok0_vocab FROM ptcv GROUP BY cluster_key, pos"),
        ("ps", "SELECT *, lag(tok0) OVER (PARTITION BY cluster_key ORDER BY pos) AS prev0, "
               "CASE WHEN has_wild OR n_tok = 1 THEN 0.0 ELSE log2(tot) - slog / tot END AS entropy FROM col"),
        ("dec", "SELECT *, CASE WHEN has_wild THEN '<*>' WHEN n_tok = 1 THEN tok0 "
                "WHEN any_nonvocab AND pos <> 0 AND entropy > 1.8 THEN '<*>' "
                "WHEN pos > 0 AND tok0_vocab AND prev0 = '=' THEN '<*>' END AS decision, "
                "CASE WHEN has_wild THEN '<*>' WHEN tok0_vocab AND entropy <= 1 THEN tok0 "
                "WHEN NOT tok0_vocab AND entropy >= 3 THEN '<*>' END AS decision_alt FROM ps"),
        ("asm", "SELECT cluster_key, bool_and(decision IS NOT NULL) AS all_decided, "
                "string_agg(decision, ' ' ORDER BY pos) AS template, "
                "list(pos ORDER BY pos) FILTER (WHERE has_wild) AS wild_pos FROM dec GROUP BY cluster_key"),
        ("wc", "SELECT s.*, a.all_decided, a.template AS asm_template, array_to_string(list_transform(range(1, len(s.tokens) + 1), "
               "lambda i: CASE WHEN list_contains(coalesce(a.wild_pos, []), i - 1) THEN '<*>' ELSE s.tokens[i] END), ' ') AS wcontent "
               "FROM same s JOIN asm a USING (cluster_key)"),
        ("truth", f"SELECT line_id, l.event_id, tt.template FROM lines l JOIN {truth_sql} ON l.event_id = tt.event_id"),
    ]


# Canonical contents per event type, known from how the lines are rendered: the
# default masks leave the constant words, R0-R6 of a region and true / false.
EVENTS_TEMPLATE_SQL = """CASE event_type WHEN 'click' THEN 'User <*> clicked on <*>' WHEN 'view' THEN 'Rendered <*> in <*>'
 WHEN 'signup' THEN 'New account created : id = <*> , region = <*>' WHEN 'purchase' THEN 'Payment accepted amount = <*> ( order <*> )'
 ELSE 'ERROR session <*> failed : code = <*> retry = <*>' END"""
EVENTS_MASKED_SQL = """CASE event_type WHEN 'click' THEN 'User <*> clicked on <*>' WHEN 'view' THEN 'Rendered <*> in <*> <*>'
 WHEN 'signup' THEN concat('New account created: id=<*>, region=R', event_id % 7)
 WHEN 'purchase' THEN 'Payment accepted amount=<*> (order <*>)'
 ELSE concat('ERROR session <*> failed: code=<*> retry=', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END) END"""
EVENTS_CATALOG_SQL = f"""SELECT md5(template) AS template_key, template, CAST(count(*) AS BIGINT) AS n_lines,
 CAST(count(DISTINCT masked) AS BIGINT) AS n_contents, CAST(min(event_id) AS BIGINT) AS first_line
 FROM (SELECT event_id, {EVENTS_TEMPLATE_SQL} AS template, {EVENTS_MASKED_SQL} AS masked FROM events) GROUP BY template"""


def with_pipeline(select: str, extra: list[tuple[str, str]] | None = None, **view) -> str:
    ctes = pipeline_ctes(**view) + (extra or [])
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes) + "\n" + select
