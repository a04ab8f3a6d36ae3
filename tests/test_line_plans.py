from tests.conftest import SF

from logloom.operators.params import extract_params
from logloom.plans.vpipe import vpipe
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_masks_run_once_per_line(spark):
    """What reads masked lines or their contents reads them as written (before: the mask chain ran for each reader)."""
    v = vpipe(spark, SF)
    assert "regexp_replace" not in _plan(v.masked) and "regexp_replace" not in _plan(v.dm)


def test_text_is_computed_once_and_patterns_per_template(spark):
    rows = [(1, "User 5 left", "User <*> left"), (1, "User 5 left", "User <*> left"), (2, "User 6 came", "User <*> left"),
            (3, "a b", "a b"), (4, None, "x <*>"), (5, "y", None), (None, "User 7 left", "User <*> left")]
    df = spark.createDataFrame(rows, "line_id long, line string, template string").withColumn("text", F.regexp_replace("line", " +", " "))
    found = extract_params(df)
    assert sorted((r.line_id or 0, r.value, r.mask_name) for r in found.collect()) == [(0, "7", "*"), (1, "5", "*"), (1, "5", "*")]
    assert "regexp_replace(line" not in _plan(found)
