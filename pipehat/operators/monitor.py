"""Security events from audit rows: detectors, alert rules, statistics, a report. Batch or streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}
OFFICE_HOURS = (8, 18)
EVENT = ["event_type", "severity", "timestamp", "user_id", "client_ip", "details"]


def _event(df: DataFrame, kind: str, severity: str, timestamp, details) -> DataFrame:
    have = set(df.columns)
    optional = lambda c: F.col(c) if c in have else F.lit(None)
    return df.select(F.lit(kind).alias("event_type"), F.lit(SEVERITY[severity]).alias("severity"), timestamp.cast("bigint").alias("timestamp"), optional("user_id").cast("bigint").alias("user_id"), optional("client_ip").cast("string").alias("client_ip"), details.alias("details"))


def after_hours(log: DataFrame, hours: tuple[int, int] = OFFICE_HOURS, utc_offset: float = 0) -> DataFrame:
    """Access to protected data before the first hour or from the second one on, that many hours from UTC, whatever the
    session's zone."""
    hour = F.floor(F.pmod(F.col("timestamp") + int(utc_offset * 3600), F.lit(86400)) / 3600)
    odd = log.where(F.col("phi_accessed") & ((hour < hours[0]) | (hour >= hours[1])))
    return _event(odd, "after_hours_access", "medium", F.col("timestamp"), F.concat(F.lit("hour "), hour.cast("string")))


def brute_force(log: DataFrame, failures: int = 5, window: str = "15 minutes", by: str = "client_ip", slide: str | None = None) -> DataFrame:
    """Sources with at least so many failures within a window. Windows follow one another, or begin anew after each slide, so
    that what crosses the end of one shows in another."""
    failed = log.where(~F.col("success")).withColumn("at", F.timestamp_seconds("timestamp"))
    counted = failed.groupBy(F.window("at", window, slide or window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= failures)
    return _event(counted, "brute_force", "high", F.unix_timestamp("w.end"), F.concat(F.col("n").cast("string"), F.lit(" failures of "), F.col(by).cast("string")))


def volume(log: DataFrame, multiplier: float = 2.0, day: str = "1 day") -> DataFrame:
    """Users whose protected records in a window exceed a multiple of their mean over all windows."""
    daily = log.where("phi_accessed").withColumn("at", F.timestamp_seconds("timestamp")).groupBy("user_id", F.window("at", day).alias("w")).agg(F.sum("phi_record_count").alias("n"))
    usual = daily.groupBy("user_id").agg(F.avg("n").alias("usual"))
    odd = daily.join(usual, "user_id").where(F.col("n") > F.col("usual") * multiplier)
    return _event(odd, "data_exfiltration", "high", F.unix_timestamp("w.end"), F.concat(F.col("n").cast("string"), F.lit(" records")))


def alerts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Each event beside the actions of the enabled rules (event_type, min_severity, action, config, enabled) it meets."""
    on = rules.where("enabled").select(F.col("event_type").alias("rule_type"), "min_severity", "action", "config")
    return events.join(on, (F.col("event_type") == F.col("rule_type")) & (F.col("severity") >= F.col("min_severity"))).drop("rule_type", "min_severity")


def blocked(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Addresses that a block_ip rule names, with when it first did."""
    return alerts(events, rules).where("action = 'block_ip' AND client_ip IS NOT NULL").groupBy("client_ip").agg(F.min("timestamp").alias("since"))


def statistics(events: DataFrame) -> DataFrame:
    """One row: total_events, critical_events, brute_force_attempts, anomalies, last_event_time."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("severity") >= SEVERITY["critical"]).alias("critical_events"),
        F.count_if(F.col("event_type") == "brute_force").alias("brute_force_attempts"),
        F.count_if(F.col("event_type").isin("after_hours_access", "data_exfiltration")).alias("anomalies"),
        F.max("timestamp").alias("last_event_time"),
    )


def report(events: DataFrame, start: int, end: int) -> DataFrame:
    """Events of each kind and severity within a range of times, both ends included."""
    inside = events.where(F.col("timestamp").between(start, end))
    return inside.groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).orderBy(F.desc("severity"), "event_type")
