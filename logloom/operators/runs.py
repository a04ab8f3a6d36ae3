"""Run-log scan, run summary line, best run per dataset, leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.raw_logs import numbered_lines

# Fixed value: the run summary sentence, as written and read back.
RUN_LINE_RE = (r"Evaluation on Dataset: (\S+), Group Accuracy: ([\d.]+), PA Accuracy: ([\d.]+), FGA: ([\d.]+), "
               r"FTA: ([\d.]+), Duration: ([\d.]+) sec, Total of (\d+) lines, rate ([\d.]+) lines/sec, (\d+) templates, "
               r"Total LLM Call count: (\d+), Total LLM Call Tokens: (\d+)")
RUN_FIELDS = [("dataset", "string"), ("ga", "double"), ("pa", "double"), ("fga", "double"), ("fta", "double"),
              ("duration", "double"), ("n_lines", "bigint"), ("rate", "double"), ("n_templates", "bigint"),
              ("llm_calls", "bigint"), ("llm_tokens", "bigint")]
METRIC_COLS = [n for n, _ in RUN_FIELDS[1:]]


def read_runs(lines: DataFrame, text_col="line", seq_col="seq") -> DataFrame:
    """Typed metrics from every line holding a run sentence."""
    m = lines.where(F.col(text_col).rlike(RUN_LINE_RE))
    cols = [F.regexp_extract(text_col, RUN_LINE_RE, i + 1).cast(t).alias(n) for i, (n, t) in enumerate(RUN_FIELDS)]
    return m.select(seq_col, *cols)


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """S5 on text files: every run sentence, ``seq`` numbering them in file order."""
    lines = numbered_lines(spark, path, lambda raw: raw.where(F.col("line").rlike(RUN_LINE_RE)), "seq")
    return read_runs(lines)


def best_run(runs: DataFrame, seq_col="seq") -> DataFrame:
    """Highest GA per dataset, the earliest run wins ties."""
    w = Window.partitionBy("dataset").orderBy(F.col("ga").desc(), F.col(seq_col).asc())
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def leaderboard(runs: DataFrame, seq_col="seq") -> DataFrame:
    """Best runs plus an ``Average`` row (each metric's mean, rounded to 4)."""
    best = best_run(runs, seq_col).select("dataset", *[F.col(c).cast("double").alias(c) for c in METRIC_COLS])
    avg = best.agg(*[F.round(F.avg(c), 4).alias(c) for c in METRIC_COLS]).select(F.lit("Average").alias("dataset"), *METRIC_COLS)
    return best.unionByName(avg)


def run_line(dataset: Column, score_row: DataFrame) -> DataFrame:
    """The summary sentence for a scored run (durations are the caller's)."""
    return score_row.select(F.format_string(
        "Evaluation on Dataset: %s, Group Accuracy: %.4f, PA Accuracy: %.4f, FGA: %.4f, FTA: %.4f, ", dataset,
        "ga", "pa", "fga", "fta").alias("line"))


def run_summary(dataset: str, scores: DataFrame) -> DataFrame:
    """E7 without timings: one typed row per scored run."""
    return scores.select(F.lit(dataset).alias("dataset"), "ga", "pa", "fga", "fta", "n_lines", "n_templates")


def write_summary(table: DataFrame, path: str) -> None:
    """The metrics table as CSV with a header (one task per output part)."""
    table.write.mode("overwrite").option("header", True).csv(path)
