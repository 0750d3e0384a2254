"""Incremental match tables and streamed matches give what one full run gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from test_assignment import sky

from skyweft.operators import incremental
from skyweft.operators.nearest import crossmatch_nearest
from skyweft.streaming import alerts

LEFT, RIGHT = "source_id long, ra double, dec double, mag double", "designation string, ra double, dec double"


def rows_of(draw: random.Random, n: int) -> tuple[list, list]:
    places = sky(draw, n // 2, (30.0, -20.0), 12.0) + sky(draw, n // 4, (0.0, 89.0), 2.0) + sky(draw, n // 4, (180.0, 45.0), 0.02)
    left = [(i, r, d, draw.random()) for i, (r, d) in enumerate(places)] + [(9000, None, 1.0, 0.5)]
    right = [(f"w{i:04d}", (r + draw.gauss(0, 3e-4)) % 360.0, max(-90.0, min(90.0, d + draw.gauss(0, 3e-4)))) for i, (r, d) in enumerate(places)]
    return left, right


def plain(df) -> list[str]:
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_updates_equal_full_runs(spark, tmp_path):
    draw = random.Random(6)
    left, right = rows_of(draw, 240)
    path = str(tmp_path / "table")

    def update() -> int:
        frames = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
        cells = incremental.update_matches(path, *frames, threshold_arcsec=3.0)
        assert plain(incremental.read_matches(spark, path)) == plain(crossmatch_nearest(*frames, threshold_arcsec=3.0))
        return cells

    first = update()
    assert first > 20 and update() == 0
    left[3] = (3, left[3][1], left[3][2], 7.5)  # another magnitude
    assert 1 <= update() <= 2
    right.append(("extra", left[5][1], left[5][2]))  # a nearer counterpart
    assert 1 <= update() <= 2
    gone = left[7]
    left = [r for r in left if r[0] != 7]  # a cell may lose its only source
    right = [r for r in right if r[0] != "w0011"]
    assert 1 <= update() <= 4
    left += [gone, gone]  # and get it back, twice
    assert 1 <= update() <= 2
    left[-1] = left[-2] = (7, gone[1], gone[2], 1.0)
    assert 1 <= update() <= 2
    left.clear()
    left.append((9000, None, 1.0, 0.5))
    assert update() > 20


def test_a_cell_without_matches_stays_empty(spark, tmp_path):
    left, right = [(1, 10.0, 10.0, 1.0), (2, 200.0, 50.0, 1.0)], [("a", 10.0, 10.0), ("b", 200.0, 50.0)]
    path = str(tmp_path / "table")
    for kept in (right, right[:1], right):
        incremental.update_matches(path, spark.createDataFrame(left, LEFT), spark.createDataFrame(kept, RIGHT))
        found = incremental.read_matches(spark, path).collect()
        assert {r.wise_designation for r in found} == {name for name, _, _ in kept}


@pytest.fixture()
def alert_files(spark, tmp_path):
    draw = random.Random(9)
    left, right = rows_of(draw, 200)
    start = datetime(2024, 5, 1)
    rows = [(f"a{i}", start + timedelta(minutes=i), r, d) for i, (_, r, d, _) in enumerate(left)]
    schema = "alert_id string, time timestamp, ra double, dec double"
    folder = str(tmp_path / "alerts")

    def arrive(part: list) -> None:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)

    return rows, right, schema, folder, arrive


def test_stream_equals_batch_and_goes_on_after_a_stop(spark, tmp_path, alert_files):
    rows, right, schema, folder, arrive = alert_files
    catalog = spark.createDataFrame(right, RIGHT)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run() -> list[str]:
        stream = alerts.read_alerts(spark, folder, schema, files_per_batch=1)
        alerts.catch_up(alerts.match_alerts(stream, catalog, out, checkpoint, left_prefix="", threshold_arcsec=3.0))
        return plain(alerts.read_matched(spark, out))

    def batch(known: list) -> list[str]:
        return plain(crossmatch_nearest(
            spark.createDataFrame(known, schema), catalog, left_key="alert_id", left_prefix="", threshold_arcsec=3.0))

    arrive(rows[:60])
    arrive(rows[40:100])  # some come again
    assert run() == batch(rows[:100])
    assert run() == batch(rows[:100])  # nothing new
    arrive(rows[90:])
    assert run() == batch(rows) and len(batch(rows)) > 100


def test_alert_rates_close_windows(spark, tmp_path, alert_files):
    rows, _, schema, folder, arrive = alert_files
    arrive(rows)
    rates = alerts.alert_rates(alerts.read_alerts(spark, folder, schema), watermark="0 seconds")
    query = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    alerts.catch_up(query)
    found = {r.start: r.n for r in spark.table("rates").collect()}
    assert sum(found.values()) == len(rows) and found[datetime(2024, 5, 1)] == 60
