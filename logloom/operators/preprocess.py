"""Preprocessing, masking, mask hit counts, distinct-content collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masking import (DEFAULT_PREFIX, DEFAULT_SUFFIX, WILDCARD, as_rules, java_pattern,
                                 mask_col, preprocess_col, replace_all_col, rstrip_col)
from ..session import written

LINES_A_SHAPE = 10  # shapes are masked instead of lines if they are fewer by this factor; either way gives the same rows


def preprocess(lines: DataFrame, regex=(), drop=(), rules=None, prefix=DEFAULT_PREFIX, suffix=DEFAULT_SUFFIX,
               text_col: str = "line", out_col: str = "content") -> DataFrame:
    """rstrip (P6) -> drop patterns (P1) -> dataset regexes (P2) -> ordered masks."""
    return lines.withColumn(out_col, preprocess_col(F.col(text_col), regex, drop, rules, prefix, suffix))


def digit_shape(text: Column) -> Column:
    """``text`` with every digit as ``1``; a text that holds ``0x`` or ``0X`` stays as it is.

    The default masks read a hexadecimal prefix (M10) and otherwise only ask
    whether a character is a digit, and none writes one, so masking the shape
    gives the shape of the masked text.
    """
    return (F.when(F.contains(text, F.lit("0x")) | F.contains(text, F.lit("0X")), text)
            .otherwise(F.translate(text, "023456789", "111111111")))


def masked_lines(lines: DataFrame, regex=(), drop=(), rules=None, text_col: str = "line") -> DataFrame:
    """(line_id, content) of every line, as ``preprocess`` makes it.

    Under the default masks lines of one shape (``digit_shape``) are masked once
    where few shapes stand for many lines: a masked shape without a ``1`` is the
    masked text of all its lines.  The lines of other shapes, and all lines under
    patterns that may tell digits apart, are masked one by one.
    """
    every = lines.select("line_id", text_col)
    plain = preprocess(every, regex, drop, rules, text_col=text_col).select("line_id", "content")
    if rules is not None or tuple(regex) or tuple(drop):
        return plain
    shaped = every.withColumn("shape", digit_shape(F.col(text_col)))
    n, shapes = shaped.agg(F.count(F.lit(1)), F.approx_count_distinct("shape")).first()
    if shapes * LINES_A_SHAPE > n:
        return plain
    distinct = written(shaped.select("shape").distinct())  # written, or the masks would be pushed below the aggregate
    known = written(preprocess(distinct, text_col="shape").where(~F.contains("content", F.lit("1"))).select("shape", "content"))
    return (shaped.join(known, "shape", "left")
            .select("line_id", F.coalesce("content", preprocess_col(F.col(text_col))).alias("content")))


def drop_patterns(lines: DataFrame, patterns, text_col="line", out_col="content") -> DataFrame:
    """Remove every match of the patterns (text is edited, rows are kept)."""
    return lines.withColumn(out_col, replace_all_col(F.col(text_col), patterns, ""))


def dataset_mask(lines: DataFrame, patterns, text_col="line", out_col="content") -> DataFrame:
    """Replace every match of the dataset's regexes by ``<*>``."""
    return lines.withColumn(out_col, replace_all_col(F.col(text_col), patterns, WILDCARD))


def mask_lines(lines: DataFrame, rules=None, prefix=DEFAULT_PREFIX, suffix=DEFAULT_SUFFIX,
               text_col="line", out_col="content") -> DataFrame:
    """Rstrip then the ordered mask chain, one projection."""
    return lines.withColumn(out_col, mask_col(rstrip_col(F.col(text_col)), rules, prefix, suffix))


def mask_hits(lines: DataFrame, rules=None, text_col="line") -> DataFrame:
    """P5: hits per rule, counted on the text that enters that rule.

    One pass: the intermediate texts are columns of one projection, the
    counts a single global aggregate (partial per task, one row out).
    """
    rules = as_rules(rules if rules is not None else __import__(
        "logloom.functions.masking", fromlist=["DEFAULT_MASK_RULES"]).DEFAULT_MASK_RULES)
    cur = rstrip_col(F.col(text_col))
    counts = []
    for i, r in enumerate(rules):
        pat = java_pattern(r.pattern)
        counts.append(F.sum(F.regexp_count(cur, F.lit(pat))).cast("bigint").alias(f"h{i + 1}"))
        cur = F.regexp_replace(cur, pat, (DEFAULT_PREFIX + r.mask_with + DEFAULT_SUFFIX).replace("$", "\\$"))
    agg = lines.agg(*counts)
    stack = ", ".join(f"{i + 1}, '{r.mask_with}', h{i + 1}" for i, r in enumerate(rules))
    return agg.selectExpr(f"stack({len(rules)}, {stack}) AS (rule_no, mask_name, hits)")


def distinct_contents(masked: DataFrame, content_col="content", line_col="line_id") -> DataFrame:
    """One row per distinct content with its weight and line span.

    A hash aggregate: partial counts per task, so a content that fills a
    third of the input still leaves one row per task before the shuffle.
    """
    return (masked.groupBy(content_col)
            .agg(F.count(F.lit(1)).alias("n"), F.min(line_col).alias("min_line"), F.max(line_col).alias("max_line")))
