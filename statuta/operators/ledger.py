"""Analytics over a ledger of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that tell a transport failure from an invalid answer, and of these the ones of a timeout; and what a
# message of an invalid answer says.
TRANSPORT = ["execution failed", "connection", "timeout", "dns", "refused", "network", "transport"]
TIMEOUT = ["timeout", "timed out", "socket.timeout"]
UNREADABLE = ["parse error", "cannot convert"]
SCHEMA, SCHEMA_FAULT = "schema", ["invalid", "mismatch", "unknown"]


def says(message: Column, words: list[str]) -> Column:
    """Whether a message holds one of the words, in any case; false for null."""
    low = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return found


def status(attempted: Column, valid: Column, error: Column) -> Column:
    """config_blocked, api_error, schema_invalid or schema_valid, the first that holds."""
    return F.when(attempted == 0, "config_blocked").when(~valid & says(error, TRANSPORT), "api_error").when(~valid, "schema_invalid").otherwise("schema_valid")


def error_category(found: Column, error: Column) -> Column:
    """The category that follows from a status: none, config_blocked, schema_invalid, timeout, transport_error or unknown."""
    return F.when(found == "schema_valid", "none").when(found.isin("config_blocked", "schema_invalid"), found).when((found == "api_error") & says(error, TIMEOUT), "timeout").when(found == "api_error", "transport_error").otherwise("unknown")


def message_status(error: Column) -> Column:
    """What a message tells: an answer that could not be read or is against the schema, else the network; null as ok."""
    return F.when(error.isNull(), "ok").when(says(error, UNREADABLE) | (says(error, [SCHEMA]) & says(error, SCHEMA_FAULT)), "invalid_schema").otherwise("network")


def summary(calls: DataFrame, *by: str) -> DataFrame:
    """Sums, counts by status, and durations (a missing one counts as 0 and in the mean) of calls (attempted, schema_valid,
    error, duration_ms, timeout_seconds, call_id)."""
    c = F.col
    s = calls.withColumn("status", status(c("attempted"), c("schema_valid"), c("error"))).withColumn("category", error_category(c("status"), c("error")))
    total = F.sum(F.coalesce("duration_ms", F.lit(0)))
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("attempted").alias("attempted"), *[F.count_if(c("status") == x).alias(x) for x in ("config_blocked", "api_error", "schema_invalid", "schema_valid")], total.alias("total_ms"), F.round(total / F.count(F.lit(1)), 4).alias("mean_ms"), F.count_if(c("category") == "timeout").alias("timeouts"), F.count_if(c("category") == "transport_error").alias("transport_errors"), F.min_by("timeout_seconds", "call_id").alias("configured_timeout"))
