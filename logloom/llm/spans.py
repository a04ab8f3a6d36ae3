"""Match positions of regular expressions with built-in functions only.

``regexp_extract_all`` gives the matches and ``split`` the text between them;
both walk the text leftmost and without overlap, so running sums of their
lengths are the positions in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 40  # code points kept before and after a match
_STEPS = [1 << i for i in range(31)]


def running_sum(values: F.Column) -> F.Column:
    """Inclusive prefix sums of an array of numbers, by doubling strides."""
    steps = F.filter(F.array(*map(F.lit, _STEPS)), lambda d: d < F.size(values))
    return F.aggregate(steps, values, lambda a, d: F.transform(
        a, lambda x, i: x + F.when(i >= d, F.get(a, i - d)).otherwise(F.lit(0))))


def add_spans(df: DataFrame, out: str, kind: str, pattern: str, keep: Callable[[F.Column], F.Column] | None = None,
              when: F.Column | None = None, text: str = "text") -> DataFrame:
    """Add ``out``: array of (kind, start, end, value, before, after) of the matches of ``pattern`` that ``keep`` accepts.

    ``when`` is a cheap necessary condition; null text has no matches.
    """
    m, p = f"__m_{out}", f"__p_{out}"
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    df = df.withColumn(m, found if when is None else F.when(when, found))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split(t, pattern, -1)))
    n = F.size(m)
    gaps, sizes = F.transform(F.slice(p, 1, n), F.length), F.transform(F.col(m), F.length)
    starts = running_sum(F.zip_with(gaps, F.concat(F.array(F.lit(0)), F.slice(sizes, 1, n - 1)), lambda a, b: a + b))
    rows = F.arrays_zip(F.col(m).alias("value"), starts.alias("start"),
                        F.transform(F.slice(p, 1, n), lambda x: F.right(x, F.lit(CONTEXT))).alias("before"),
                        F.transform(F.slice(p, 2, n), lambda x: F.left(x, F.lit(CONTEXT))).alias("after"))
    spans = F.transform(rows, lambda r: F.struct(
        F.lit(kind).alias("kind"), r["start"].cast("long").alias("start"),
        (r["start"] + F.length(r["value"])).cast("long").alias("end"),
        r["value"].alias("value"), r["before"].alias("before"), r["after"].alias("after")))
    if keep is not None:
        spans = F.filter(spans, keep)
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>>")
    return df.withColumn(out, F.when(F.col(p).isNotNull(), spans).otherwise(none)).drop(m, p)


def joined(spans: F.Column) -> F.Column:
    """``kind:start:end`` of the spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def total(spans: str) -> F.Column:
    return F.size(spans).cast("long")


def sql_spans(kind: str, pattern: str, keep: str = "true") -> str:
    """DuckDB: list of {k, s, e, v, b, a} of the kept matches of ``pattern`` in ``text``."""
    q = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(text, '{q}')) + 1), lambda i: {{
      'k': '{kind}',
      's': CAST(list_sum(list_transform(string_split_regex(text, '{q}')[:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(regexp_extract_all(text, '{q}')[:i - 1], lambda x: length(x))), 0) AS BIGINT),
      'v': regexp_extract_all(text, '{q}')[i],
      'b': right(string_split_regex(text, '{q}')[i], {CONTEXT}),
      'a': left(string_split_regex(text, '{q}')[i + 1], {CONTEXT})}}), lambda m: {keep})"""


def sql_joined(spans: str) -> str:
    return f"array_to_string(list_transform({spans}, lambda m: concat(m.k, ':', m.s, ':', m.s + length(m.v))), ',')"
