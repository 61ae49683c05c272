"""The registered queries in SQL, for comparison on another engine."""

from __future__ import annotations

# The flat events that the nested ones must become, before any type is dropped.
FLAT = """
SELECT event_id,
       event_id * 1000 AS event_timestamp,
       strftime(ts, '%H') AS hh,
       CASE WHEN event_id % 50 = 0 THEN 'bad_type' WHEN event_id % 77 = 0 THEN NULL ELSE event_type END AS event_type,
       'app' || cast(user_id % 3 AS varchar) AS app_id,
       'com.example.app' AS package_name,
       'Example' AS app_title,
       cast(user_id % 12 + 1 AS varchar) AS app_version_code,
       CASE WHEN event_id % 40 = 0 THEN NULL
            WHEN event_id % 41 = 0 THEN 'dev'
            ELSE cast(user_id % 12 + 1 AS varchar) || '.' || cast(event_id % 10 AS varchar) || '.0'
       END AS app_version_name,
       'pool' AS cognito_identity_pool_id,
       'sdk' AS sdk_name,
       '2.4' AS sdk_version,
       's' || cast(user_id * 100 + event_id % 7 AS varchar) AS session_id,
       (event_id - event_id % 7) * 1000 AS session_start_timestamp,
       CASE user_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'IS' WHEN 2 THEN 'DE' END AS country,
       CASE user_id % 4 WHEN 0 THEN 'en_US' WHEN 1 THEN 'is_IS' ELSE 'de_DE' END AS device_locale_code,
       CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'is' ELSE 'de' END AS language,
       CASE WHEN user_id % 2 = 0 THEN 'ios' ELSE 'android' END AS platform,
       cast(user_id % 5 + 7 AS varchar) AS platform_version,
       CASE WHEN user_id % 2 = 0 THEN 'apple' ELSE 'acme' END AS make,
       'm' || cast(user_id % 9 AS varchar) AS model,
       'cg' || cast(user_id AS varchar) AS cognito_id,
       'cl' || cast(user_id AS varchar) AS client_id,
       cast(user_id AS varchar) AS user_id,
       CASE WHEN event_type = 'purchase' THEN value END AS metrics_amount
FROM events
"""

# Columns of the flat events apart from the group keys, with the types that JSON inference gives them.
COLUMN_TYPES = {
    "event_id": "bigint",
    "event_timestamp": "bigint",
    "app_id": "string",
    "package_name": "string",
    "app_title": "string",
    "app_version_code": "string",
    "app_version_name": "string",
    "cognito_identity_pool_id": "string",
    "sdk_name": "string",
    "sdk_version": "string",
    "session_id": "string",
    "session_start_timestamp": "bigint",
    "country": "string",
    "device_locale_code": "string",
    "language": "string",
    "platform": "string",
    "platform_version": "string",
    "make": "string",
    "model": "string",
    "cognito_id": "string",
    "client_id": "string",
    "user_id": "string",
    "metrics_amount": "double",
}

_counts = ", ".join(f"count({c}) AS n_{c}" for c in COLUMN_TYPES)
_masked = ", ".join(f"CASE WHEN n_{c} > 0 THEN retained.{c} END AS {c}" for c in COLUMN_TYPES)


def _steps(group: str) -> dict[str, str]:
    """Steps of the narrowing, each reading the ones before it, for groups by the given columns."""
    return {
        "flat": FLAT,
        "retained": """
            SELECT * FROM flat
            WHERE event_type IS NOT NULL AND event_type NOT IN ('error')
              AND NOT regexp_matches(event_type, '[_,\\s]')""",
        "counts": f"SELECT {group}, app_version_name, count(*) AS n FROM retained GROUP BY {group}, app_version_name",
        "newest": f"""
            SELECT {group}, max(app_version_name) AS app_version_name FROM counts
            WHERE regexp_matches(app_version_name, '\\d+.\\d+.\\d+') GROUP BY {group}""",
        "sample": f"""
            SELECT * FROM (
              SELECT *, cast(row_number() OVER (PARTITION BY {group} ORDER BY event_id) AS integer) AS sample_rank
              FROM retained JOIN newest USING ({group}, app_version_name)) AS ranked
            WHERE sample_rank <= 10""",
        "flags": f"SELECT {group}, {_counts} FROM retained JOIN newest USING ({group}, app_version_name) GROUP BY {group}",
        "narrowed": f"SELECT retained.hh, retained.event_type, {_masked} FROM retained JOIN flags USING ({group})",
    }


def _after(last: str, query: str, group: str = "hh, event_type") -> str:
    """The query with the steps up to ``last`` before it."""
    steps = _steps(group)
    needed = list(steps)[: list(steps).index(last) + 1]
    return "WITH " + ",\n".join(f"{name} AS ({steps[name]})" for name in needed) + "\n" + query


def _narrowed_values() -> str:
    """Values of columns that the newest version does not show, and serials of other versions that its type cannot hold.

    Version nine has serials of a digit and no legacy field; any other one has longer ones than a long holds.
    """
    nine = "app_version_name LIKE '9.%'"
    lost = " UNION ALL ".join(
        f"SELECT hh, event_type, '{c}' AS \"column\", 'dropped' AS reason, count({c}) AS n "
        f"FROM retained JOIN flags USING (hh, event_type) WHERE n_{c} = 0 GROUP BY hh, event_type HAVING count({c}) > 0"
        for c in COLUMN_TYPES
    )
    others = f"""
        SELECT hh, event_type, count(*) AS n
        FROM retained JOIN (SELECT hh, event_type FROM newest WHERE {nine}) USING (hh, event_type)
        WHERE app_version_code <> '9' GROUP BY hh, event_type"""
    return f"""
        {lost}
        UNION ALL SELECT hh, event_type, 'legacy', 'dropped', n FROM ({others})
        UNION ALL SELECT hh, event_type, 'serial', 'misfit', n FROM ({others})"""


def _lines_schema() -> str:
    """The columns of a type's lines that hold any value; the type is the name of its directory."""
    types = {"event_type": "string", "hh": "string", **COLUMN_TYPES}
    shown = ", ".join(f"CASE WHEN count({c}) > 0 THEN '{c}:{types[c]}' END" for c in sorted(types))
    return f"SELECT event_type AS et, 'struct<' || concat_ws(',', {shown}) || '>' AS lines_schema FROM retained GROUP BY event_type"


def _schema_text() -> str:
    types = {"hh": "string", "event_type": "string", **COLUMN_TYPES}
    fields = []
    for name in sorted(types):
        shown = f"n_{name} > 0" if name in COLUMN_TYPES else "true"
        fields.append(f"CASE WHEN {shown} THEN '{name}:{types[name]}' END")
    return "'struct<' || concat_ws(',', " + ", ".join(fields) + ") || '>'"


_NARROWED_COLUMNS = ", ".join(["event_type", *COLUMN_TYPES])

ORACLE: dict[str, str] = {
    "flat_events": _after("flat", "SELECT *, event_type AS et FROM flat"),
    "flat_array_leaves": """
        SELECT event_id,
               'k' || cast(user_id % 5 AS varchar) || ',gift' AS items_sku,
               cast(event_id % 4 AS varchar) || ',1' AS items_qty,
               cast(event_id % 3 AS varchar) || '+' || cast(event_id % 5 AS varchar) || ','
                 || cast(user_id % 2 AS varchar) AS items_offers_code
        FROM events""",
    "distinct_event_types": _after("flat", "SELECT DISTINCT event_type FROM flat ORDER BY event_type DESC NULLS LAST"),
    "retained_events": _after("retained", "SELECT event_id, hh, event_type FROM retained"),
    "skipped_events": _after(
        "flat",
        """SELECT CASE WHEN event_type IS NULL THEN 'no type' WHEN event_type = 'error' THEN 'denied'
                  ELSE 'unclean name' END AS reason, event_type, count(*) AS n
           FROM flat
           WHERE event_type IS NULL OR event_type = 'error' OR regexp_matches(event_type, '[_,\\s]')
           GROUP BY event_type""",
    ),
    "events_per_type_hour": _after(
        "retained", "SELECT event_type, hh, count(*) AS n FROM retained GROUP BY event_type, hh"
    ),
    "events_per_path": """
        SELECT strftime(ts, '%Y/%m/%d') AS day_path, strftime(ts, '%H') AS hh, count(*) AS n,
               max(strftime(ts, '%Y-%m-%d')) AS day
        FROM events GROUP BY 1, 2""",
    "version_counts": _after("counts", "SELECT * FROM counts"),
    "version_pattern": _after(
        "flat",
        "SELECT regexp_matches(app_version_name, '\\d+.\\d+.\\d+') AS matches, count(*) AS n FROM flat GROUP BY 1",
    ),
    "top_versions_per_type": _after(
        "retained",
        """SELECT * FROM (
             SELECT event_type, app_version_name, count(*) AS n,
                    cast(row_number() OVER (
                      PARTITION BY event_type ORDER BY app_version_name DESC NULLS LAST) AS integer) AS version_rank
             FROM retained GROUP BY event_type, app_version_name) AS ranked
           WHERE version_rank <= 100""",
    ),
    "newest_version_lexicographic": _after("newest", "SELECT * FROM newest"),
    "newest_version_numeric": _after(
        "counts",
        """SELECT hh, event_type, app_version_name FROM (
             SELECT *, row_number() OVER (
                 PARTITION BY hh, event_type
                 ORDER BY cast(split_part(app_version_name, '.', 1) AS bigint) DESC,
                          cast(split_part(app_version_name, '.', 2) AS bigint) DESC,
                          cast(split_part(app_version_name, '.', 3) AS bigint) DESC) AS place
             FROM (SELECT * FROM counts WHERE regexp_matches(app_version_name, '^[0-9]+[.][0-9]+[.][0-9]+$')) AS v) AS r
           WHERE place = 1""",
    ),
    "newest_version_sample": _after(
        "sample", "SELECT hh, event_type, app_version_name, event_id, sample_rank FROM sample"
    ),
    "type_column_presence": _after(
        "retained", f"SELECT hh, event_type, {_counts} FROM retained GROUP BY hh, event_type"
    ),
    "type_schema": _after("flags", f"SELECT hh, event_type, {_schema_text()} AS type_schema FROM flags"),
    "narrowed_events": _after("narrowed", "SELECT * FROM narrowed"),
    "json_roundtrip_inferred": _after("flat", "SELECT * FROM flat"),
    "json_partition_scan": _after("retained", "SELECT *, event_type AS et FROM retained"),
    "json_schema_on_read": _after(
        "flat",
        """SELECT cast(event_id AS varchar) AS event_id, event_timestamp, cast(NULL AS bigint) AS app_version_code,
                  cast(metrics_amount AS varchar) AS metrics_amount, hh, cast(NULL AS varchar) AS absent
           FROM flat""",
    ),
    "compact_small_files": """
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, user_id, event_type, value, props,
               'h' || strftime(ts, '%H') AS directory
        FROM events""",
    "compacted_file_counts": """
        SELECT 'h' || strftime(ts, '%H') AS directory, count(*) AS lines, true AS as_few_as_needed FROM events GROUP BY 1""",
    "parquet_capped_write": _after("retained", "SELECT *, true AS within_cap FROM retained"),
    "publish_day": _after("narrowed", "SELECT *, '20180601' AS dt, event_type AS et FROM narrowed"),
    # All events are one hour here, so the type alone makes a group.
    "split_and_narrow_hour": _after("narrowed", "SELECT * FROM narrowed", "event_type"),
    "preprocess_day_narrow": _after("narrowed", f"SELECT {_NARROWED_COLUMNS}, event_type AS et, hh FROM narrowed"),
    "preprocess_day_runs": _after("narrowed", f"SELECT {_NARROWED_COLUMNS}, event_type AS et, hh FROM narrowed"),
    "concurrent_publish": _after("narrowed", f"SELECT {_NARROWED_COLUMNS}, event_type AS et, hh FROM narrowed"),
    "resumed_day": _after("narrowed", f"SELECT {_NARROWED_COLUMNS}, event_type AS et, hh FROM narrowed"),
    "reconciled_hours": _after(
        "newest",
        """SELECT event_id, event_type,
                  CASE WHEN cast(hh AS integer) % 3 = 0 THEN cast(event_id % 1000 AS varchar)
                       WHEN cast(hh AS integer) % 3 = 1 THEN cast(event_id % 1000 AS varchar) || '.5'
                       ELSE 's' || cast(event_id % 7 AS varchar) END AS score,
                  event_type AS et, hh
           FROM retained SEMI JOIN newest USING (hh, event_type)""",
    ),
    "narrowed_values": _after("flags", _narrowed_values()),
    "type_partition_schemas": _after("retained", _lines_schema()),
    "preprocess_day_wide": _after("narrowed", f"SELECT {_NARROWED_COLUMNS}, event_type AS et, hh FROM narrowed"),
    "warehouse_to_lake": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
        FROM orders""",
    "lake_to_warehouse": """
        SELECT vec_id, label, array_to_string(list_transform(embedding,
                   lambda x: cast(floor(cast(x AS double) * 1099511627776) AS bigint)), ',') AS components
        FROM embeddings""",
    "lake_to_warehouse_lineitem": """
        SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate) FROM lineitem""",
    "country_chain": _after("flat", "SELECT DISTINCT country FROM flat"),
    "country_chain_retried": _after(
        "flat", "SELECT country, CASE WHEN country = 'US' THEN 2 ELSE 1 END::BIGINT AS runs FROM flat GROUP BY country"
    ),
}
