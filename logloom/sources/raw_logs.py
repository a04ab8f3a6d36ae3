"""Header-format compile and raw log scan; S3/S4 structured/catalog scans.

The header format (``<Date> <Time> <Level> <Component>: <Content>``) becomes
one anchored Java regex with positional groups.  Literal pieces may carry
their own groups (e.g. ``(\\[<PID>\\])?``), so every field's group index is
computed; fields inside an optional group read NULL when absent.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.masking import WS_CLASS
from ..session import checkpoint_dir


@dataclass(frozen=True)
class HeaderFormat:
    headers: list[str]
    regex: str                 # positional groups, no inline flags
    group_of: dict[str, int]   # field -> 1-based group index
    optional: frozenset[str]   # fields inside an optional literal group


def _count_groups(piece: str) -> list[tuple[int, int]]:
    """(position, +1/-1) for capturing group opens / closes in a regex piece."""
    out, i = [], 0
    while i < len(piece):
        ch = piece[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "(":
            out.append((i, 1 if not piece.startswith("(?", i) else 0))
        elif ch == ")":
            out.append((i, -1))
        i += 1
    return out


def compile_header(fmt: str) -> HeaderFormat:
    """``<Field>`` -> ``(.*?)``; runs of spaces in literal pieces -> ``\\s+``."""
    parts = re.split(r"(<[^<>]+>)", fmt)
    regex, headers, group_of, optional = "", [], {}, set()
    n_groups, depth_stack = 0, []
    for k, piece in enumerate(parts):
        if k % 2 == 0:
            lit = re.sub(r" +", r"\\s+", piece)
            for _, kind in _count_groups(lit):
                if kind == 1:
                    n_groups += 1
                    depth_stack.append(True)
                elif kind == 0:
                    depth_stack.append(False)
                else:
                    if depth_stack:
                        depth_stack.pop()
            regex += lit
        else:
            name = piece.strip("<").strip(">")
            n_groups += 1
            group_of[name] = n_groups
            headers.append(name)
            if depth_stack:
                optional.add(name)
            regex += "(.*?)"
    return HeaderFormat(headers, "^" + regex + "$", group_of, frozenset(optional))


def parse_headers(lines: DataFrame, fmt: str | HeaderFormat, text_col="line", unicode=True) -> DataFrame:
    """S2 without numbering: strip, keep matching lines, one column per field."""
    hf = compile_header(fmt) if isinstance(fmt, str) else fmt
    pat = ("(?U)" if unicode else "") + hf.regex
    stripped = F.regexp_replace(F.regexp_replace(F.col(text_col), "^" + WS_CLASS + "+", ""), WS_CLASS + r"+\z", "")
    df = lines.withColumn("_s", stripped).where(F.col("_s").rlike(pat))
    cols = []
    for h in hf.headers:
        c = F.regexp_extract("_s", pat, hf.group_of[h])
        cols.append((F.nullif(c, F.lit("")) if h in hf.optional else c).alias(h))
    keep = [c for c in lines.columns if c != text_col]
    return df.select(*keep, *cols)


def sum_before(totals: DataFrame, order: list[str], value: str, out_col: str) -> DataFrame:
    """``totals`` plus ``out_col``: the sum of ``value`` over all rows before this one in ``order`` (unique).

    The table is dealt by sampled ranges of the order and materialised; each
    range is summed in its own task, and only the ranges' totals (one row per
    shuffle partition) meet in one window.
    """
    spark = totals.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = totals.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    heads = rows.groupBy("_p").agg(F.sum(value).alias("_t"))
    heads = heads.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_before"))
    return (rows.withColumn("_in", F.coalesce(inside, F.lit(0))).join(heads, "_p")
            .withColumn(out_col, F.col("_in") + F.col("_before")).drop("_p", "_in", "_before"))


def number_rows(df: DataFrame, order_col: str, out_col: str = "LineId", by: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """1-based rank by a unique key, within ``by`` if given, without a window over all rows.

    Rows are dealt by sampled ranges of (by, key), sorted in their range and
    materialised once with their place in it, so the plan has the same size for
    any number of partitions and a ``by`` value that holds most rows is spread
    over many of them.  Places become ranks by the counts of each (by, range),
    at most one row per range and ``by`` value.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (df.repartitionByRange(n, *by, order_col).sortWithinPartitions(*by, order_col)
            .withColumn("_p", F.spark_partition_id())
            .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint())
    counts = rows.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_at").alias("_first"))
    before = F.sum("_cnt").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_cnt")
    shift = counts.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
                          (before - F.col("_first") + 1).alias("_shift"))
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return (rows.join(shift, same).withColumn(out_col, (F.col("_at") + F.col("_shift")).cast("bigint"))
            .select(*df.columns, out_col))


def numbered_lines(spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame], out_col: str) -> DataFrame:
    """Rows that ``keep`` makes of the text files' lines (column ``line``), numbered from 1 by (file, block, position in block).

    Rows of one file block are read by one task in file order, so the
    monotonically increasing id orders them inside the block; blocks are
    counted (one row each) and turned into offsets in (file, block) order.
    ``keep`` must pass the other columns on.
    """
    raw = (spark.read.text(path)
           .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"),
                   F.col("_metadata.file_block_start").alias("_blk"), F.monotonically_increasing_id().alias("_m")))
    rows = keep(raw)
    counts = rows.groupBy("_f", "_blk").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = sum_before(counts, ["_f", "_blk"], "_cnt", "_off").select("_f", "_blk", "_off")
    w = Window.partitionBy("_f", "_blk").orderBy("_m")
    return (rows.withColumn("_r", F.row_number().over(w)).join(offsets, ["_f", "_blk"])
            .withColumn(out_col, (F.col("_off") + F.col("_r")).cast("bigint"))
            .drop("_f", "_blk", "_m", "_off", "_r"))


def read_raw_logs(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """S2 on text files: the lines that fit the header, numbered in file order."""
    return numbered_lines(spark, path, lambda raw: parse_headers(raw, fmt), "LineId")


STRUCTURED_SCHEMA = "LineId bigint, Content string, EventId string, EventTemplate string"


def read_structured(spark: SparkSession, path: str, schema: str | None = STRUCTURED_SCHEMA, multiline: bool = False) -> DataFrame:
    """S3: structured CSV (LineId, Content, EventId, EventTemplate, ...).

    Log lines hold no line break, so files are split among tasks; ``multiline``
    reads quoted breaks, one task per file.  ``schema=None`` takes the header's
    columns as strings.
    """
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=multiline,
                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_truth_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Template catalogs with either ``EventID`` or ``EventId`` headers."""
    df = spark.read.csv(path, header=True, escape='"')
    cols = {c.lower(): c for c in df.columns}
    occ = F.col(cols["occurrence"]).cast("bigint") if "occurrence" in cols else F.lit(None).cast("bigint")
    return df.select(F.col(cols["eventid"]).alias("event_id"), F.col(cols["eventtemplate"]).alias("template"),
                     occ.alias("occurrence"))
