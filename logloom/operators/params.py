"""O1-O3: template -> capture regex, parameter table, parameter profile."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masking import DEFAULT_MASK_RULES, as_rules
from ..session import written

_SPECIAL = r"([\\.^$|?*+()\[\]{}])"


def _escaped(part: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(part, _SPECIAL, r"\\$1"), " ", r"\\s+")


def mask_names(rules=None) -> list[str]:
    """Names a template may hold between ``<`` and ``>``: those of the rules, and the catch-all ``*``."""
    return list(dict.fromkeys([r.mask_with for r in as_rules(rules if rules is not None else DEFAULT_MASK_RULES)] + ["*"]))


def _slot(rules) -> str:
    """Pattern of one mask in a template; group 1 is its name."""
    return "<(" + "|".join(re.escape(n) for n in sorted(mask_names(rules), key=len, reverse=True)) + ")>"


def slot_names(template: Column, rules=None) -> Column:
    """Mask names of a template in the order of its slots."""
    return F.regexp_extract_all(template, F.lit(_slot(rules)), F.lit(1))


def _group(name: str, exact: bool, rules) -> str:
    """Capture group of a slot: any text, or with ``exact`` the patterns of its rules (any text last for ``*``)."""
    alts = [_noncapturing(r.pattern) for r in as_rules(rules if rules is not None else DEFAULT_MASK_RULES)
            if r.mask_with == name] if exact else []
    return "(" + "|".join(alts + [".+?"] * (not exact or name == "*" or not alts)) + ")"


def param_regex(template: Column, exact: bool = False, rules=None) -> Column:
    """O1: escaped literal parts, each mask one positional capture group,
    spaces -> ``\\s+``, anchored."""
    parts = F.transform(F.split(template, _slot(rules), -1), _escaped)
    group = F.create_map(*[x for n in mask_names(rules) for x in (F.lit(n), F.lit(_group(n, exact, rules)))])
    groups = F.transform(slot_names(template, rules), lambda n: F.element_at(group, n))
    joined = F.zip_with(parts, groups, lambda p, g: F.concat(p, F.coalesce(g, F.lit(""))))
    return F.concat(F.lit("^"), F.array_join(joined, ""), F.lit("$"))


def _noncapturing(p: str) -> str:
    """The pattern with every plain or named group non-capturing, so that only
    slots capture; back-references become ``(?:.+?)``."""
    p = re.sub(r"\\(?!0)\d{1,2}|\\k<\w+>|\(\?P=\w+\)", "(?:.+?)", p)
    out, i, in_class = [], 0, False
    while i < len(p):
        ch = p[i]
        if ch == "\\":
            out.append(p[i:i + 2])
            i += 2
            continue
        named = None if in_class else re.compile(r"\(\?P?<\w+>").match(p, i)
        if named:
            out.append("(?:")
            i = named.end()
            continue
        in_class = ch == "[" or in_class and ch != "]"
        out.append("(?:" if ch == "(" and not in_class and not p.startswith("(?", i) else ch)
        i += 1
    return "".join(out)


def extract_params(lines: DataFrame, text_col: str = "text", template_col: str = "template",
                   key_cols=("line_id",), exact: bool = False, rules=None) -> DataFrame:
    """O2: (line, position, mask name, value) for lines whose text the
    template's regex matches.  The lines are written once, since their text is
    read for the match and for every capture; a pattern is made once per
    template.  Rows are sorted by template inside each task so the JVM compiles
    each pattern once per run of equal templates."""
    lines = written(lines.select(*key_cols, text_col, template_col))
    patterns = (lines.select(template_col).distinct().withColumn("_pat", param_regex(F.col(template_col), exact, rules))
                .withColumn("_names", slot_names(F.col(template_col), rules)).withColumn("_k", F.size("_names")).where("_k > 0"))
    df = lines.join(patterns, template_col).sortWithinPartitions("_pat").where(F.expr(f"`{text_col}` RLIKE _pat"))
    caps = F.expr(f"transform(_names, (n, i) -> struct(n AS mask_name, regexp_extract(`{text_col}`, _pat, i + 1) AS value))")
    return (df.select(*key_cols, template_col, F.posexplode(caps).alias("position", "s"))
            .select(*key_cols, template_col, F.col("position").cast("bigint").alias("position"), "s.value", "s.mask_name"))


def top_values(params: DataFrame, k: int, template_col: str = "template") -> DataFrame:
    """O3: the ``k`` most frequent values of every template slot, ties to the smaller value: rank, value and count.

    The rank's limit is applied in each task before the shuffle, so a slot with
    very many values sends at most ``k`` rows a task to its window.
    """
    per_value = params.groupBy(template_col, "position", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(template_col, "position").orderBy(F.col("n").desc(), F.col("value").asc())
    return per_value.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def param_profile(params: DataFrame, template_col: str = "template") -> DataFrame:
    """O3: per template slot, values, exact distinct values and the top value."""
    per_value = params.groupBy(template_col, "position", "value").agg(F.count(F.lit(1)).alias("c"))
    top = top_values(params, 1, template_col).select(template_col, "position", F.col("value").alias("top_value"), F.col("n").alias("top_count"))
    agg = per_value.groupBy(template_col, "position").agg(
        F.sum("c").cast("bigint").alias("n_values"), F.count(F.lit(1)).cast("bigint").alias("n_distinct"))
    return agg.join(top, [template_col, "position"])


#: 2^12 registers: standard error 1.6 %; values tracked by a frequent-item sketch
HLL_BITS, TRACKED = 12, 4096


def param_sketches(params: DataFrame, template_col: str = "template", by: tuple[str, ...] = ()) -> DataFrame:
    """O3 as state: per slot (and ``by``, such as a batch) the count and two sketches of bounded size that add up.

    Written once per batch, the profile of any span of batches is
    ``merge_sketches`` of their rows, without their lines.
    """
    return params.groupBy(template_col, "position", *by).agg(
        F.count(F.lit(1)).alias("n_values"), F.hll_sketch_agg("value", HLL_BITS).alias("distinct_sketch"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("top_sketch"))


def merge_sketches(sketches: DataFrame, template_col: str = "template") -> DataFrame:
    """One row per slot from any number of rows of ``param_sketches``."""
    return sketches.groupBy(template_col, "position").agg(
        F.sum("n_values").alias("n_values"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.expr(f"approx_top_k_combine(top_sketch, {TRACKED})").alias("top_sketch"))


def sketch_profile(sketches: DataFrame, k: int = 3) -> DataFrame:
    """``sketches`` with n_distinct (estimate) and top (at most ``k`` of item and count) in place of the sketches.

    Counts are exact while a slot has fewer than three quarters of ``TRACKED`` values.
    """
    return (sketches.withColumn("n_distinct", F.hll_sketch_estimate("distinct_sketch"))
            .withColumn("top", F.expr(f"approx_top_k_estimate(top_sketch, {k})")).drop("distinct_sketch", "top_sketch"))
