"""The log table, its rollup, and the view of the sample tables as logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ["debug", "info", "warn", "error"]
LOGS = "timestamp timestamp, id bigint, level string, service string, message string, attributes variant, attr_text map<string,string>, ingested_at timestamp, month string"
ROLLUP = "bucket_start timestamp, service string, level string, count bigint"
REJECTS = "writer string, batch bigint, index bigint, reason string, month string"


def month_of(timestamp: Column) -> Column:
    """The partition of a log: its UTC month."""
    return F.date_format(timestamp, "yyyy_MM")


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as logs: id, timestamp, service, level, message, attr_text, props (the attributes' JSON)."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "purchase", "warn").when(kind == "signup", "info").otherwise("debug")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), kind.alias("service"), level.alias("level"),
        F.concat(kind, F.lit(" user "), F.col("user_id").cast("string")).alias("message"),
        F.from_json("props", "map<string,string>").alias("attr_text"), "props",
    )


#: The same view for SQL.
EVENT_LOGS_SQL = """logs as (
  select event_id as id, ts as "timestamp", event_type as service,
         case event_type when 'error' then 'error' when 'purchase' then 'warn' when 'signup' then 'info' else 'debug' end as level,
         event_type || ' user ' || user_id as message, json_extract_string(props, '$.k') as attr_k
  from events)"""
