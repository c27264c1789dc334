"""Queries agree with their SQL where values meet a limit, or rows a place in the order, exactly."""

import datetime
import json
import os

import duckdb
import pytest

from wayfold.plans import all_queries, all_sql

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = datetime.datetime(2024, 1, 1)
with open(os.path.join(os.path.dirname(__file__), "ties.json")) as f:
    TIES = json.load(f)


def both(spark, folder, name, rows):
    """Rows of a query over events (seconds, user, kind, x, y), which are those of its SQL."""
    events = [(i, START + datetime.timedelta(seconds=s), rec, kind, float(x), json.dumps({"k": y})) for i, (s, rec, kind, x, y) in enumerate(rows)]
    spark.createDataFrame(events, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    found = all_queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{folder}/events.parquet/*.parquet'")
    wanted = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in found.columns)} FROM ({all_sql()[name]})").fetchall()
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == sorted(wanted)
    return rows


def recorded(name):
    """Rows of the users in ties.json, one after the other in time."""
    return [(10 * k + int(rec), int(rec), "view", x, y) for rec, places in TIES[name].items() for k, (x, y) in enumerate(places)]


def test_points_on_the_edge_of_a_polygon(spark, tmp_path):
    assert both(spark, tmp_path, "in_polygons", [(0, 1, "view", 20.0, 30), (1, 1, "view", 400.0, 55), (2, 1, "view", 19.99, 30), (3, 1, "view", 240.0, 30), (4, 1, "view", 100.0, 69)]) == [(0,), (4,)]


def test_chains_with_rows_of_one_time(spark, tmp_path):
    assert [r[:3] for r in both(spark, tmp_path, "chain_parts", [(0, 0, "view", 0, 5), (1, 6, "view", 100, 5), (1, 12, "view", 300, 5), (2, 0, "view", 300, 5)])] == [(0, 0, 1), (0, 1, 1), (0, 2, 2)]


def test_tracks_of_a_type_without_limits_and_steps_of_the_limit(spark, tmp_path):
    steps = [(k, 2, "purchase", x, y) for k, (x, y) in enumerate([(160.1 + 0.07 * (k % 9), 120) if k % 2 else (0.1 + 0.07 * ((k + 1) % 9), 0) for k in range(40)])]
    rows = both(spark, tmp_path, "track_split", [(0, 1, "error", 0, 5), (1, 1, "error", 10, 5), (2, 1, "error", 40, 5), *steps])
    assert (1, "error", 0, 2, 0) in rows and (1, "error", 1, 1, 2) in rows


def test_gaps_over_half_a_turn(spark, tmp_path):
    assert len(both(spark, tmp_path, "single_gap_fill", recorded("single_gap_fill"))) == 2


def test_paths_that_turn_back(spark, tmp_path):
    assert len(both(spark, tmp_path, "wiggle", recorded("wiggle"))) == 2


def test_touches_are_contacts(spark, tmp_path):
    rows = []
    for n in range(60):
        ego, y, dx, dy = 5 * n, 20 + n, *[(27.5, 0), (16.5, 4.4), (22.0, 3.3)][n % 3]
        rows += [(k, rec, "view", x, v) for k, (rec, x, v) in enumerate([(ego, 100.0, y), (ego, 100.0, y), (ego + 1, 400.0, y), (ego + 1, 100.0 + dx, y + dy)])]
    assert len(both(spark, tmp_path, "first_contact", rows)) == 60


def test_points_just_in_reach(spark, tmp_path):
    assert both(spark, tmp_path, "lidar_collision", recorded("lidar_collision"))


def test_path_points_between_two_cells(spark, tmp_path):
    assert both(spark, tmp_path, "map_collision", recorded("map_collision"))
