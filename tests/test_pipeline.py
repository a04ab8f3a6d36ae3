"""Closed loop: mining the events view recovers its five true templates."""

from logloom.operators.metrics import score
from logloom.plans.mine import line_templates, mine_templates
from logloom.sources import tables

from .conftest import SF


def test_events_quality(spark):
    res = mine_templates(tables.events_log(spark, SF))
    s = score(line_templates(res), tables.events_truth(spark, SF)).first()
    assert (s.ga, s.pa, s.fga, s.fta) == (1.0, 1.0, 1.0, 1.0)
    assert res.assignments.count() == tables.events_log(spark, SF).count()


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 5
    assert len(E.oracle_sql()) > 0 and set(E.oracle_sql()) <= set(E.queries())
