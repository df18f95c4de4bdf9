"""The points of sql_volume_at are numbered as they are listed, whatever the number of executors."""

from orbweave.plans.catalogue import QUERIES


def test_points_have_a_fixed_order(spark, data):
    plan = QUERIES["sql_volume_at"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # its order after an exchange is that in which blocks arrive
