"""Small SQL-expression vocabulary for two dialects.

Text rules (tokenizer, preprocessing) are written once against this
interface.  ``SPARK`` renders Spark SQL that we evaluate with ``F.expr``;
``DUCK`` renders the same rule for the DuckDB correctness oracle.  Only
function names, literal quoting, lambda syntax and list indexing differ.
"""

from __future__ import annotations


class Dialect:
    name = "base"

    # literals -----------------------------------------------------------
    def s(self, text: str) -> str:  # plain string literal
        raise NotImplementedError

    def re(self, pattern: str) -> str:  # regex literal, backslashes kept verbatim
        raise NotImplementedError

    # lambdas and lists ----------------------------------------------------
    def lam(self, params: str, body: str) -> str:
        raise NotImplementedError

    def arr(self, *items: str) -> str:
        raise NotImplementedError

    def let(self, name: str, value: str, body: str) -> str:
        """Evaluate ``value`` once and bind it to ``name`` inside ``body``."""
        raise NotImplementedError

    def transform(self, a: str, var: str, body: str) -> str:
        raise NotImplementedError

    def filter(self, a: str, var: str, body: str) -> str:
        raise NotImplementedError

    def filter_idx(self, a: str, var: str, idx: str, body_fn) -> str:
        """``body_fn(i0)`` gets an expression for the 0-based index."""
        raise NotImplementedError

    def at0(self, a: str, i0: str) -> str:
        """Element at 0-based index (NULL when out of range)."""
        raise NotImplementedError

    def size(self, a: str) -> str:
        raise NotImplementedError

    def concat(self, *arrs: str) -> str:
        raise NotImplementedError

    def flatten(self, a: str) -> str:
        return f"flatten({a})"

    def join(self, a: str, sep: str) -> str:
        raise NotImplementedError

    # strings --------------------------------------------------------------
    def rlike(self, s: str, pattern: str) -> str:
        raise NotImplementedError

    def split_re(self, s: str, pattern: str) -> str:
        raise NotImplementedError

    def extract(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.re(pattern)}, {group})"

    def extract_all(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.re(pattern)}, {group})"

    def replace_re(self, s: str, pattern: str, repl: str) -> str:
        raise NotImplementedError


class SparkDialect(Dialect):
    name = "spark"

    def s(self, text):
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def re(self, pattern):
        if "'" in pattern:
            return self.s(pattern)
        return "r'" + pattern + "'"

    def lam(self, params, body):
        return f"({params}) -> {body}" if "," in params else f"{params} -> {body}"

    def arr(self, *items):
        return "array(" + ", ".join(items) + ")"

    def let(self, name, value, body):
        return f"transform(array({value}), {name} -> {body})[0]"

    def transform(self, a, var, body):
        return f"transform({a}, {var} -> {body})"

    def filter(self, a, var, body):
        return f"filter({a}, {var} -> {body})"

    def filter_idx(self, a, var, idx, body_fn):
        return f"filter({a}, ({var}, {idx}) -> {body_fn(idx)})"

    def at0(self, a, i0):
        return f"CASE WHEN ({i0}) >= 0 THEN try_element_at({a}, ({i0}) + 1) END"

    def size(self, a):
        return f"size({a})"

    def concat(self, *arrs):
        return "concat(" + ", ".join(arrs) + ")"

    def join(self, a, sep):
        return f"array_join({a}, {self.s(sep)})"

    def rlike(self, s, pattern):
        return f"({s} RLIKE {self.re(pattern)})"

    def split_re(self, s, pattern):
        return f"split({s}, {self.re(pattern)})"

    def replace_re(self, s, pattern, repl):
        # Java replacement strings treat $ and \ specially
        repl = repl.replace("\\", "\\\\").replace("$", "\\$")
        return f"regexp_replace({s}, {self.re(pattern)}, {self.s(repl)})"


class DuckDialect(Dialect):
    name = "duckdb"

    def s(self, text):
        return "'" + text.replace("'", "''") + "'"

    def re(self, pattern):
        return self.s(pattern)

    def lam(self, params, body):
        return f"lambda {params}: {body}"

    def arr(self, *items):
        return "[" + ", ".join(items) + "]"

    def let(self, name, value, body):
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def transform(self, a, var, body):
        return f"list_transform({a}, lambda {var}: {body})"

    def filter(self, a, var, body):
        return f"list_filter({a}, lambda {var}: {body})"

    def filter_idx(self, a, var, idx, body_fn):
        return f"list_filter({a}, lambda {var}, {idx}: {body_fn(f'({idx} - 1)')})"

    def at0(self, a, i0):
        return f"{a}[({i0}) + 1]"

    def size(self, a):
        return f"len({a})"

    def concat(self, *arrs):
        out = arrs[-1]
        for a in reversed(arrs[:-1]):
            out = f"list_concat({a}, {out})"
        return out

    def join(self, a, sep):
        return f"array_to_string({a}, {self.s(sep)})"

    def rlike(self, s, pattern):
        return f"regexp_matches({s}, {self.re(pattern)})"

    def split_re(self, s, pattern):
        return f"string_split_regex({s}, {self.re(pattern)})"

    def replace_re(self, s, pattern, repl):
        repl = repl.replace("\\", "\\\\")
        return f"regexp_replace({s}, {self.re(pattern)}, {self.s(repl)}, 'g')"


SPARK = SparkDialect()
DUCK = DuckDialect()
