"""Message tokenizer (T1-T9) as one SQL expression over a string column.

Rules, in order:
  T1 ``,`` -> ``, `` then split on whitespace;
  T2 a message of at most one token is not split further;
  T3 leading / trailing runs of ``, . ! ? ; :`` become one token per char;
  T4 key/value split at the first ``=`` and/or ``:``;
  T5 one bracket split per piece (``[]`` and ``()`` only, not recursive);
  T6 tokens holding ``<*>``: split if they hold a separator, and every piece
     holding ``<*>`` becomes ``<*>``; otherwise the token becomes ``<*>``;
  T7 a ``<*>`` right after a ``<*>`` is dropped, *before* empty pieces are
     removed;
  T8 empties removed, ``__DASH__`` restored to ``-`` (the only way a literal
     ``__DASH__`` in the input differs from a dash-protected split).

The expression is built against :mod:`sqlexpr` so that Spark evaluates it in
the JVM and the DuckDB oracle evaluates the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .masking import WILDCARD, WS_CLASS
from .sqlexpr import SPARK, Dialect

PUNCT = "[,.!?;:]"
BRACKETS = r"[\[\]()]"
SEPARATORS = r"[=:{}()\[\],.]"


def _kv_split(d: Dialect, m: str) -> str:
    """T4 on the punctuation-stripped middle ``m`` (a bound variable)."""
    e, c = f"instr({m}, '=')", f"instr({m}, ':')"
    n_eq = f"(length({m}) - length(replace({m}, '=', '')))"
    n_co = f"(length({m}) - length(replace({m}, ':', '')))"
    eq, co = d.s("="), d.s(":")
    both_eq_first = d.arr(f"substring({m}, 1, {e} - 1)", eq, f"substring({m}, {e} + 1, {c} - {e} - 1)", co,
                          f"substring({m}, {c} + 1)")
    both_co_first = d.arr(f"substring({m}, 1, {c} - 1)", co, f"substring({m}, {c} + 1, {e} - {c} - 1)", eq,
                          f"substring({m}, {e} + 1)")
    return (
        f"CASE WHEN {e} > 0 AND {c} > 0 THEN (CASE WHEN {e} < {c} THEN {both_eq_first} ELSE {both_co_first} END) "
        f"WHEN {n_eq} = 1 OR ({n_eq} > 1 AND instr({m}, '==') = 0) "
        f"THEN {d.arr(f'substring({m}, 1, {e} - 1)', eq, f'substring({m}, {e} + 1)')} "
        f"WHEN {n_co} = 1 OR ({n_co} > 1 AND instr({m}, '::') = 0) "
        f"THEN {d.arr(f'substring({m}, 1, {c} - 1)', co, f'substring({m}, {c} + 1)')} "
        f"ELSE {d.arr(m)} END"
    )


def _bracket_split(d: Dialect, p: str) -> str:
    """T5 on one piece ``p`` (a bound variable); returns an array."""
    n = "_bn"
    first, last = f"substring({p}, 1, 1)", f"substring({p}, {n}, 1)"
    lo, hi = d.s("["), d.s("]")
    po, pc = d.s("("), d.s(")")
    rule1 = f"{n} > 1 AND (({first} = {lo} AND {last} = {hi}) OR ({first} = {po} AND {last} = {pc}))"
    rule2 = f"{n} > 1 AND (({first} = {lo} AND instr({p}, {hi}) = 0) OR ({first} = {po} AND instr({p}, {pc}) = 0))"
    head = f"substring({p}, 1, {n} - 1)"
    rule3 = f"{n} > 1 AND (({last} = {hi} AND instr({head}, {lo}) = 0) OR ({last} = {pc} AND instr({head}, {po}) = 0))"
    # first bracket character at 1-based index >= 2
    lead = f"length({d.extract(f'substring({p}, 2)', '^[^' + BRACKETS[1:-1] + ']*', 0)})"
    i, ch, k = "_bi", "_bc", "_bk"
    closer = f"CASE WHEN {ch} = {lo} THEN {hi} ELSE {pc} END"
    with_closer = d.arr(f"substring({p}, 1, {i} - 1)", ch, f"substring({p}, {i} + 1, {k} - 1)",
                        f"substring({p}, {i} + {k}, 1)", f"substring({p}, {i} + {k} + 1)")
    without_closer = d.arr(f"substring({p}, 1, {i})", f"substring({p}, {i} + 1)")
    opener_case = d.let(k, f"instr(substring({p}, {i} + 1), {closer})",
                        f"CASE WHEN {k} > 0 THEN {with_closer} ELSE {without_closer} END")
    scan = d.let(i, f"{lead} + 2", d.let(ch, f"substring({p}, {i}, 1)",
                                         f"CASE WHEN {ch} = {lo} OR {ch} = {po} THEN {opener_case} "
                                         f"ELSE {d.arr(f'substring({p}, 1, {i} - 1)', ch, f'substring({p}, {i} + 1)')} END"))
    body = (
        f"CASE WHEN {rule1} THEN {d.arr(first, f'substring({p}, 2, {n} - 2)', last)} "
        f"WHEN {rule2} THEN {d.arr(first, f'substring({p}, 2)')} "
        f"WHEN {rule3} THEN {d.arr(head, last)} "
        f"WHEN {n} > 2 AND {lead} < {n} - 1 THEN {scan} "
        f"ELSE {d.arr(p)} END"
    )
    return d.let(n, f"length({p})", body)


def split_string_sql(d: Dialect, t: str) -> str:
    """T3 + T4 + T5 on one whitespace token ``t`` (a bound variable)."""
    f, r, b, m = "_sf", "_sr", "_sb", "_sm"
    pieces = d.concat(d.extract_all(f, PUNCT, 0), _kv_split(d, m), d.extract_all(b, PUNCT, 0))
    body = d.let(f, d.extract(t, "^" + PUNCT + "*", 0),
                 d.let(r, f"substring({t}, length({f}) + 1)",
                       d.let(b, d.extract(r, PUNCT + "*$", 0),
                             d.let(m, f"substring({r}, 1, length({r}) - length({b}))", pieces))))
    return d.flatten(d.transform(body, "_bp", _bracket_split(d, "_bp")))


def _token_pieces(d: Dialect, t: str) -> str:
    """T6 for one whitespace token."""
    w = d.s(WILDCARD)
    absorbed = d.transform(split_string_sql(d, t), "_wp", f"CASE WHEN instr(_wp, {w}) > 0 THEN {w} ELSE _wp END")
    return (
        f"CASE WHEN {t} = {w} THEN {d.arr(w)} "
        f"WHEN instr({t}, {w}) > 0 AND {d.rlike(t, SEPARATORS)} THEN {absorbed} "
        f"WHEN instr({t}, {w}) > 0 THEN {d.arr(w)} "
        f"ELSE {split_string_sql(d, t)} END"
    )


def tokenize_sql(d: Dialect, msg: str) -> str:
    """Full tokenizer T1-T8: string expression -> array<string> expression."""
    w = d.s(WILDCARD)
    initial = d.filter(d.split_re(f"replace({msg}, ',', ', ')", WS_CLASS + "+"), "_x", "_x <> ''")
    processed = f"CASE WHEN {d.size('_it')} <= 1 THEN _it ELSE {d.flatten(d.transform('_it', '_t', _token_pieces(d, '_t')))} END"
    collapsed = d.filter_idx("_pt", "_y", "_yi",
                             lambda i0: f"NOT (_y = {w} AND {i0} > 0 AND coalesce({d.at0('_pt', f'{i0} - 1')} = {w}, false))")
    final = d.transform(d.filter(collapsed, "_z", "_z <> ''"), "_q", "replace(_q, '__DASH__', '-')")
    return d.let("_it", initial, d.let("_pt", processed, final))


def tokenize_col(c: Column) -> Column:
    """Spark column: masked message -> array<string> of tokens."""
    return F.expr(tokenize_sql(SPARK, "(" + _col_sql(c) + ")"))


def _col_sql(c: Column) -> str:
    # only plain column references are passed around here
    return c._jc.toString()  # noqa: SLF001 - stable Column -> SQL text for simple refs


def tokenize_expr(col_name: str) -> Column:
    return F.expr(tokenize_sql(SPARK, f"`{col_name}`"))
