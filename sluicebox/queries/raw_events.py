"""The nested events that the registered queries read, derived from the whole ``events`` table.

Every value follows from an event's id, user, type, time and value, so that SQL over the same table can say what the
flat events must be. The thirty days of the table count as one day, so that each hour holds enough events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluicebox.session import configure

DAY = "20180601"
DENIED = ["error"]

FIELDS = [
    """CASE WHEN event_id % 50 = 0 THEN 'bad_type' WHEN event_id % 77 = 0 THEN NULL ELSE event_type END AS event_type""",
    "'account' AS awsAccountId",
    "struct('c' AS custom) AS client_context",
    """struct(
        'com.example.app' AS package_name,
        'Example' AS title,
        string(user_id % 12 + 1) AS version_code,
        'app' || user_id % 3 AS app_id,
        'pool' AS cognito_identity_pool_id,
        CASE WHEN event_id % 40 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'dev'
             ELSE concat_ws('.', user_id % 12 + 1, event_id % 10, 0) END AS version_name,
        struct('2.4' AS version, 'sdk' AS name) AS sdk) AS application""",
    """struct(
        's' || (user_id * 100 + event_id % 7) AS session_id,
        (event_id - event_id % 7) * 1000 AS start_timestamp) AS session""",
    """struct(
        struct(
            CASE user_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'IS' WHEN 2 THEN 'DE' END AS country,
            CASE user_id % 4 WHEN 0 THEN 'en_US' WHEN 1 THEN 'is_IS' ELSE 'de_DE' END AS code,
            CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'is' ELSE 'de' END AS language) AS locale,
        struct(
            string(user_id % 5 + 7) AS version,
            if(user_id % 2 = 0, 'ios', 'android') AS name) AS platform,
        if(user_id % 2 = 0, 'apple', 'acme') AS make,
        'm' || user_id % 9 AS model) AS device""",
    "struct('cg' || user_id AS cognito_id, 'cl' || user_id AS client_id) AS client",
    "struct(string(user_id) AS user_id, string(event_id % 5) AS Level) AS attributes",
    "event_id",
    "event_id * 1000 AS event_timestamp",
    "date_format(ts, 'HH') AS hh",
    "struct(CASE WHEN event_type = 'purchase' THEN value END AS amount) AS metrics",
]

# Arrays of structs, and arrays of those within arrays.
ITEMS = """array(
    struct('k' || user_id % 5 AS sku, event_id % 4 AS qty,
           array(struct(event_id % 3 AS code), struct(event_id % 5 AS code)) AS offers),
    struct('gift' AS sku, 1L AS qty, array(struct(user_id % 2 AS code)) AS offers)) AS items"""


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/events.parquet")


def raw_events(spark: SparkSession, sf_dir: str, with_items: bool = False) -> DataFrame:
    fields = [*FIELDS, ITEMS] if with_items else FIELDS
    return load_events(spark, sf_dir).selectExpr(*fields)
