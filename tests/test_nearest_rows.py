from __future__ import annotations

import __spark_entry__ as entry
from conftest import plan_text
from skyweft.operators.nearest import NearestOptions, crossmatch_nearest
from skyweft.streaming import alerts

SMALL = "/root/testdata/sf0.001"


def _sky(spark, n, offset, key):
    place = f"10 + (id * 37 % 101) * 2e-4 + {offset}D ra", f"-60 + (id * 53 % 97) * 2e-4 dec"
    return spark.range(n).selectExpr(f"{key} AS name", *place)


def test_many_right_rows_are_joined_as_rows_and_not_broadcast(spark):
    """Files of a few MB may hold rows of many; arrays of a row each cost a sort before the shuffle."""
    left = _sky(spark, 3000, 3e-5, "id").union(spark.sql("SELECT -1L, NULL, 1D")).withColumnRenamed("name", "source_id")
    right = _sky(spark, 2500, 0.0, "concat('W', id)").withColumnRenamed("name", "designation")
    found = {}
    for how in ("inner", "left"):
        for name, options in (("rows", NearestOptions(max_broadcast_rows=100)), ("arrays", NearestOptions(salt_left=True))):
            near = crossmatch_nearest(left, right, threshold_arcsec=2.0, how=how, options=options)
            plan = plan_text(near)
            found[how, name] = sorted(near.collect(), key=str)
            if name == "rows":
                assert "SortMergeJoin" in plan and "Broadcast" not in plan and "collect_list" not in plan
        assert found[how, "rows"] == found[how, "arrays"]
    assert len(found["left", "rows"]) == 3001 > len(found["inner", "rows"]) > 1000


def test_the_best_candidate_is_found_once(spark):
    assert "ArrowEvalPython" not in plan_text(entry.queries()["top_candidate_lightcurve"](spark, SMALL))


def test_a_batch_of_alerts_is_deduplicated_once(spark, tmp_path, monkeypatch):
    seen = []

    def near(left, *args, **kwargs):
        seen.append(plan_text(left))
        return crossmatch_nearest(left, *args, **kwargs)

    monkeypatch.setattr(alerts, "crossmatch_nearest", near)
    rows = "name alert_id", "ra", "dec", "timestamp '2020-01-01' + make_interval(0, 0, 0, 0, 0, name % 7) time"
    arrived = _sky(spark, 200, 0.0, "id").selectExpr(*rows)
    arrived.union(arrived).write.parquet(f"{tmp_path}/in")
    stream = alerts.read_alerts(spark, f"{tmp_path}/in", arrived.schema)
    alerts.catch_up(alerts.match_alerts(
        stream, _sky(spark, 200, 0.0, "concat('W', id)").withColumnRenamed("name", "designation"), f"{tmp_path}/out", f"{tmp_path}/state"))
    assert alerts.read_matched(spark, f"{tmp_path}/out").count() == 200
    assert seen and not any("Dedup" in plan for plan in seen)
