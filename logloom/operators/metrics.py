"""Grouping / parsing accuracy and their template-level F-measures.

Inputs ``pred(line_id, event_id, template)`` and ``truth(line_id, event_id,
template)``.  One equi-join on ``line_id`` (H4), then everything works on
the (predicted id, true id) contingency table, whose size is bounded by the
number of templates, not lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def template_equal(template: Column, truth: Column) -> Column:
    """Truth runs of 2+ ``<*>`` -> ``<*> ``; whitespace dropped on both sides."""
    t = F.regexp_replace(truth, r"(?U)(<\*>[\s]*){2,}", "<*> ")
    return F.regexp_replace(template, r"(?U)\s+", "") == F.regexp_replace(t, r"(?U)\s+", "")


def contingency(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(pid, tid, c) plus group sizes and the template of each side.

    The predicted template is the one of the group's last line and the true
    template that of the true group's first line, as in the reference.
    """
    p = pred.select("line_id", F.col("event_id").alias("pid"), F.col("template").alias("ptemplate"))
    t = truth.select("line_id", F.col("event_id").alias("tid"), F.col("template").alias("ttemplate"))
    j = p.join(t, "line_id")
    cont = j.groupBy("pid", "tid").agg(F.count(F.lit(1)).alias("c"))
    ptab = (p.groupBy("pid").agg(F.count(F.lit(1)).alias("psz"), F.max_by("ptemplate", "line_id").alias("ptemplate")))
    ttab = (t.groupBy("tid").agg(F.count(F.lit(1)).alias("tsz"), F.min_by("ttemplate", "line_id").alias("ttemplate")))
    w = Window.partitionBy("pid")
    return (cont.withColumn("n_tid", F.count(F.lit(1)).over(w))
            .join(ptab, "pid").join(ttab, "tid")
            .withColumn("group_match", (F.col("n_tid") == 1) & (F.col("psz") == F.col("tsz")))
            .withColumn("template_match", template_equal(F.col("ptemplate"), F.col("ttemplate"))))


def _f(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.round(2 * p * r / (p + r), 4)).otherwise(F.lit(0.0))


def score(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """E1, E2, E4, E5 as one row: ga, pga, rga, fga, pa, pta, rta, fta, counts."""
    cont = contingency(pred, truth)
    agg = cont.agg(
        F.sum(F.when(F.col("group_match"), F.col("c")).otherwise(0)).alias("ga_cnt"),
        F.sum(F.when(F.col("template_match"), F.col("c")).otherwise(0)).alias("pa_cnt"),
        F.sum(F.when(F.col("group_match"), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("group_match") & F.col("template_match"), 1).otherwise(0)).alias("ta"),
        F.countDistinct("pid").alias("n_pred"), F.sum("c").alias("n_lines"))
    n_truth = truth.agg(F.countDistinct("event_id").alias("n_truth"))
    r = agg.crossJoin(n_truth)  # one row x one row
    pga, rga = F.round(F.col("tp") / F.col("n_pred"), 4), F.round(F.col("tp") / F.col("n_truth"), 4)
    pta, rta = F.round(F.col("ta") / F.col("n_pred"), 4), F.round(F.col("ta") / F.col("n_truth"), 4)
    return (r.select(
        F.round(F.col("ga_cnt") / F.col("n_lines"), 4).alias("ga"), pga.alias("pga"), rga.alias("rga"),
        F.round(F.col("pa_cnt") / F.col("n_lines"), 4).alias("pa"), pta.alias("pta"), rta.alias("rta"),
        F.col("n_pred").cast("bigint").alias("n_templates"), F.col("n_truth").cast("bigint").alias("n_truth"),
        F.col("n_lines").cast("bigint").alias("n_lines"))
        .withColumn("fga", _f(F.col("pga"), F.col("rga")))
        .withColumn("fta", _f(F.col("pta"), F.col("rta")))
        .select("ga", "pga", "rga", "fga", "pa", "pta", "rta", "fta", "n_templates", "n_truth", "n_lines"))


def grouping_accuracy(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """E1 detail: per predicted group, whether its lines count toward GA."""
    return (contingency(pred, truth)
            .select("pid", "tid", "c", "psz", "tsz", "n_tid", "group_match"))


def missed_lines(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Lines of a true group that sit outside the pure predicted group holding it."""
    cont = contingency(pred, truth).where("n_tid = 1 AND NOT group_match").select("pid", "tid")
    t = truth.select("line_id", F.col("event_id").alias("tid"))
    p = pred.select("line_id", F.col("event_id").alias("pid"))
    in_group = t.join(cont, "tid").join(p, ["line_id", "pid"], "left_anti")
    return in_group.select("tid", "pid", "line_id")


def occurrence(truth: DataFrame) -> DataFrame:
    """Lines per true template."""
    return truth.groupBy("event_id", "template").agg(F.count(F.lit(1)).alias("occurrence"))
