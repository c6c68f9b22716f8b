"""The ``events`` table read as an analysis change log (key ``user_id``).

signup / purchase = put (payload value, props, kind), click = patch of the
whitelisted ``value`` column, error = delete, view = ignored.  Order key is
``(ts, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

KEY = "user_id"
PAYLOAD = ["value", "props", "kind"]
PATCHABLE = ["value"]

# Event type → log operation.
OPS = {"signup": "put", "purchase": "put", "click": "patch", "error": "delete"}


def events_log(spark: SparkSession, sf_dir: str, ops: tuple[str, ...] = ("put", "patch", "delete")) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    op = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in OPS.items()])
    is_put = F.col("op") == "put"
    return (ev.withColumn("op", op)
              .where(F.col("op").isin(*ops))
              .select(KEY, "op", "ts", F.col("event_id").alias("seq"), F.col("ts").alias("created_hint"),
                      F.when(F.col("op") != "delete", F.col("value")).alias("value"),
                      F.when(is_put, F.col("props")).alias("props"),
                      F.when(is_put, F.col("event_type")).alias("kind")))


def duck_log_cte(ops: tuple[str, ...] = ("put", "patch", "delete")) -> str:
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPS.items())
    inlist = ", ".join(f"'{o}'" for o in ops)
    return f"""log AS (SELECT * FROM (SELECT user_id, CASE event_type {case} END AS op, ts, event_id AS seq,
  value, CASE WHEN event_type IN ('signup', 'purchase') THEN props END AS props,
  CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS kind FROM events) e
  WHERE op IN ({inlist}))"""


def duck_fold_sql(ops: tuple[str, ...]) -> str:
    return f"""WITH {duck_log_cte(ops)},
ranked AS (SELECT *, max(CASE WHEN op = 'delete' THEN (ts, seq) END) OVER (PARTITION BY user_id) AS d FROM log),
live AS (SELECT * FROM ranked WHERE op <> 'delete' AND (d IS NULL OR (ts, seq) > d)),
lp AS (SELECT user_id, props, kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rn
       FROM live WHERE op = 'put'),
lv AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rn FROM live),
ag AS (SELECT user_id, min(CASE WHEN op = 'put' THEN ts END) AS created_at, max(ts) AS updated_at,
       count(CASE WHEN op = 'put' THEN 1 END) AS puts FROM live GROUP BY user_id)
SELECT ag.user_id, lv.value, lp.props, lp.kind, ag.created_at, ag.updated_at
FROM ag JOIN lp ON lp.user_id = ag.user_id AND lp.rn = 1 JOIN lv ON lv.user_id = ag.user_id AND lv.rn = 1
WHERE ag.puts > 0"""
