"""Ordered regex masking (P1-P6, M1-M13) as folded ``regexp_replace`` calls.

A rule is ``(pattern, mask_name)``.  Rules run in order and each sees the
output of the previous one, so the fold happens inside one projection and is
evaluated by the JVM per row; no UDF is involved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqlexpr import Dialect

# ---------------------------------------------------------------------------
# The default masking rules, in the order they must be applied.
# Each masks with "*", i.e. is replaced by "<*>" (prefix "<", suffix ">").
#  M1  weekday month day time [zone] year
#  M2  one capital letter and two digits between whitespace
#  M3  a run of two or more <*> becomes one
#  M4  full eight-group IPv6 address
#  M5  dotted host name ending in com/net/org/cn/io/edu, optional port
#  M6  optional scheme, host:port
#  M7  path or URL tail with optional query string
#  M8  colon-separated hex groups (MAC-like)
#  M9  IPv4 address
#  M10 0x/0X hex number, or six or more hex digits of one case
#  M11 signed integer between non-alphanumerics
#  M12 size and time units
#  M13 quoted command after "executed cmd "
# ---------------------------------------------------------------------------
DEFAULT_MASK_RULES: list[tuple[str, str]] = [
    (r"(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\s+(\d{1,2}:\d{1,2}:\d{1,2})(?:\s+[A-Z]+)?\s+(\d{4})", "*"),
    (r"(?<=\s)[A-Z]\d{2}(?=\s)", "*"),
    (r"(<\*>)(?:\s+<\*>)+", "*"),
    (r"((?<=[^A-Za-z0-9])|^)(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4})((?=[^A-Za-z0-9])|$)", "*"),
    (r"([\w-]+\.){2,}(com|net|org|cn|io|edu)(:\d{1,5})?", "*"),
    (r"(?:(?:https?|hdfs|ftp|tcp)://)?[\w.-]+:\d{1,5}(?=[\s:;.,\])}]|$)", "*"),
    (r"(://|//|\.?/)[^\s)]+(?:/[^\s)]*)*+/?(?<!:)(\?[^\s)]*)?", "*"),
    (r"((?<=[^A-Za-z0-9])|^)(([0-9a-fA-F]{2,}:){3,}([0-9a-fA-F]{2,}))((?=[^A-Za-z0-9])|$)", "*"),
    (r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "*"),
    (r"((?<=[^A-Za-z0-9])|^)(?:0[X]([A-F0-9]+)|0[x]([a-f0-9]+))((?=[^A-Za-z0-9])|$)|((?<=[^A-Za-z0-9])|^)([A-F0-9]{6,})((?=[^A-Za-z0-9])|$)|((?<=[^A-Za-z0-9])|^)([a-f0-9]{6,})((?=[^A-Za-z0-9])|$)", "*"),
    (r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)", "*"),
    (r"(?<![A-Za-z0-9])((B|KB|MB|GB|sec|secs|kbps))(?![A-Za-z0-9])", "*"),
    (r"(?<=executed cmd )(\".+?\")", "*"),
]
# A text without the literal cannot match the rule (rule number -> literal).
DEFAULT_GUARDS = {DEFAULT_MASK_RULES[n - 1][0]: lit for n, lit in (
    (1, ":"), (3, "<*>"), (4, ":"), (5, "."), (6, ":"), (7, "/"), (8, ":"), (9, "."), (13, "executed cmd "))}
DEFAULT_PREFIX = "<"
DEFAULT_SUFFIX = ">"
WILDCARD = "<*>"

# Python's str.split()/rstrip() whitespace set, as one explicit character class
# that both Java regex and RE2 read the same way.
WS_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@dataclass(frozen=True)
class MaskRule:
    pattern: str
    mask_with: str = "*"


def as_rules(rules) -> list[MaskRule]:
    out = []
    for r in rules:
        out.append(r if isinstance(r, MaskRule) else MaskRule(r[0], r[1] if len(r) > 1 else "*"))
    return out


def java_pattern(pattern: str, unicode: bool = True) -> str:
    """Python ``re`` on ``str`` is Unicode-aware; Java needs ``(?U)`` for that."""
    return "(?U)" + pattern if unicode else pattern


def _quote_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def rstrip_col(c: Column) -> Column:
    """Python ``str.rstrip()``."""
    return F.regexp_replace(c, WS_CLASS + r"+\z", "")


def mask_col(c: Column, rules=None, prefix: str = DEFAULT_PREFIX, suffix: str = DEFAULT_SUFFIX,
             unicode: bool = True) -> Column:
    """Apply the ordered rules; a hit becomes prefix + mask name + suffix."""
    rules = as_rules(DEFAULT_MASK_RULES if rules is None else rules)
    for r in rules:
        c = _guarded(c, DEFAULT_GUARDS.get(r.pattern), java_pattern(r.pattern, unicode),
                     _quote_replacement(prefix + r.mask_with + suffix))
    return c


def _guarded(c: Column, literal: str | None, pattern: str, replacement: str) -> Column:
    """``regexp_replace``, run only on texts that hold ``literal``; the text so far is evaluated once."""
    if literal is None:
        return F.regexp_replace(c, pattern, replacement)
    return F.transform(F.array(c), lambda x: F.when(F.contains(x, F.lit(literal)), F.regexp_replace(x, pattern, replacement))
                       .otherwise(x))[0]


def replace_all_col(c: Column, patterns, replacement: str, unicode: bool = True) -> Column:
    """P1 (replacement ``''``) and P2 (replacement ``'<*>'``)."""
    for p in patterns:
        c = F.regexp_replace(c, java_pattern(p, unicode), _quote_replacement(replacement))
    return c


def preprocess_col(c: Column, regex=(), drop=(), rules=None, prefix=DEFAULT_PREFIX, suffix=DEFAULT_SUFFIX) -> Column:
    """rstrip -> drop patterns (P1) -> dataset regexes (P2) -> mask chain."""
    c = rstrip_col(c)
    c = replace_all_col(c, drop, "")
    c = replace_all_col(c, regex, WILDCARD)
    return mask_col(c, rules, prefix, suffix)


# --- dialect-neutral text of the same steps (used by the DuckDB oracle) -----

def preprocess_sql(d: Dialect, expr: str, regex=(), drop=(), rules=()) -> str:
    """SQL text of rstrip + P1 + P2 + P3 with RE2-compatible patterns only."""
    out = d.replace_re(expr, WS_CLASS + r"+\z", "")
    for p in drop:
        out = d.replace_re(out, p, "")
    for p in regex:
        out = d.replace_re(out, p, WILDCARD)
    for r in as_rules(rules):
        out = d.replace_re(out, r.pattern, DEFAULT_PREFIX + r.mask_with + DEFAULT_SUFFIX)
    return out
