"""Where queries and their DuckDB SQL are kept by name."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The pose view of the event table, as sources.tables.poses has it.
POSE = """pose AS (SELECT user_id AS rec, event_id, epoch_us(ts) / 1e6 AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
 event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f FROM events)"""


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name."""

    def put(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql.replace("{POSE}", POSE)
        return function

    return put
