"""Raw log entries to canonical events and correlation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.config import WorldConfig
from flowrisk.functions import expressions as X
from flowrisk.schema import LOG_ENTRY, as_canonical


def parse_entries(entries: DataFrame, column: str = "entry") -> DataFrame:
    """Parse each entry once and name its format; text that is no JSON object has format ``malformed``.

    A field of another type than expected is null and costs nothing else of the entry.
    """
    log = F.from_json(F.col(column), LOG_ENTRY,
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    scheduler = F.col("log.jsonPayload.@type").startswith(C.SCHEDULER_TYPE_PREFIX)
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(column))).startswith("OBJECT"), F.lit(False))
    fmt = (F.when(F.col("log").isNull() | (F.col("log._corrupt_record").isNotNull() & ~readable), "malformed")
           .when(scheduler, "scheduler")
           .when(F.col("log.logName").contains(C.REQUEST_LOG_MARKER), "request")
           .when(F.col("log.protoPayload").isNotNull() & F.col("log.timestamp").isNotNull(), "audit")
           .otherwise("unknown"))
    # Generating the struct keeps the parser from being repeated for every field read from it.
    return entries.select("*", F.explode(F.array(log)).alias("log")).withColumn("log_format", fmt)


def canonicalize_audit(parsed: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """Canonical events from audit entries with a readable timestamp."""
    p = "log.protoPayload."
    method, service = F.coalesce(p + "methodName", F.lit("")), F.coalesce(p + "serviceName", F.lit(""))
    resource = F.coalesce(p + "resourceName", F.lit("unknown"))
    actor = F.coalesce(p + "authenticationInfo.principalEmail", F.lit("unknown"))
    insert_id, log_name = F.coalesce("log.insertId", F.lit("")), F.coalesce("log.logName", F.lit(""))
    trigger = F.col("log.metadata.trigger_ref")
    chain = F.filter(
        F.transform(p + "authenticationInfo.serviceAccountDelegationInfo",
                    lambda d: d["firstPartyPrincipal"]["principalEmail"]),
        lambda e: e.isNotNull() & (e != ""))
    base = (parsed.where(F.col("log_format") == "audit")
            .withColumns({"_method": method, "_service": service, "target_id": resource, "actor_id": actor,
                          "ts": X.parse_ts(F.col("log.timestamp"))})
            .where(F.col("ts").isNotNull())
            .withColumn("action_type", X.map_action(F.col("_service"), F.col("_method")))
            .withColumn("_zone", X.map_zone(F.col("_service"), F.col("_method"))))
    leaves = (F.col("_zone") == "DATA") & X.is_exfil_risk(F.col("target_id"), F.col("action_type"))
    return as_canonical(base.withColumns({
        "target_zone": F.when(leaves, "EXFIL_RISK").otherwise(F.col("_zone")),
        "target_type": F.when(leaves, "EXFIL_RISK_DEST").otherwise(X.resource_type(F.col("target_id"))),
        "event_id": X.event_content_id(F.col("log.timestamp"), F.col("actor_id"), F.col("_method"),
                                       F.col("target_id"), insert_id),
        "window_start": X.floor_window(F.col("ts"), cfg.window_minutes),
        "actor_type": X.actor_type(F.col("actor_id")),
        "action_subtype": F.nullif(F.col("_method"), F.lit("")),
        "result": F.when(F.coalesce(F.col(p + "status.code").try_cast("int"), F.lit(0)) != 0, "FAIL").otherwise("SUCCESS"),
        "project_id": F.col("log.resource.labels.project_id"),
        "trigger_ref": trigger,
        "provenance_level": F.when(F.coalesce(trigger, F.lit("")) != "", "WEAK").otherwise("NONE"),
        "is_infrastructure": X.is_infrastructure(F.col("actor_id")),
        "delegation_chain": F.coalesce(chain, F.array().cast("array<string>")),
        "raw_ref": F.when(log_name != "", F.concat_ws(":", log_name, insert_id)).otherwise(insert_id),
    }))


def canonicalize_scheduler(parsed: DataFrame) -> DataFrame:
    """Scheduler attempts; a scheduled time only on starts, an HTTP status only on ends."""
    j = "log.jsonPayload."
    name = F.coalesce(j + "jobName", F.lit(""))
    return parsed.where(F.col("log_format") == "scheduler").select(
        name.alias("job_name"),
        F.coalesce("log.resource.labels.job_id", F.element_at(F.split(name, "/"), -1)).alias("job_id"),
        F.col(j + "url").alias("target_url"),
        F.expr(f"substr(log.jsonPayload.`@type`, {len(C.SCHEDULER_TYPE_PREFIX) + 1})").alias("attempt_type"),
        X.parse_ts(F.col("log.timestamp")).alias("timestamp"),
        F.coalesce("log.insertId", F.lit("")).alias("insert_id"),
        F.coalesce("log.resource.labels.project_id", F.lit("")).alias("project_id"),
        X.parse_ts(F.col(j + "scheduledTime")).alias("scheduled_time"),
        F.col("log.httpRequest.status").try_cast("int").alias("http_status"),
        F.col(j + "status").alias("status"))


def canonicalize_requests(parsed: DataFrame) -> DataFrame:
    """Service requests with latency in seconds and the scheduler flag."""
    h, labels = "log.httpRequest.", "log.resource.labels."
    return parsed.where(F.col("log_format") == "request").select(
        F.coalesce(labels + "service_name", F.lit("")).alias("service_name"),
        F.coalesce(h + "requestUrl", F.lit("")).alias("request_url"),
        F.coalesce(F.col(h + "status").try_cast("int"), F.lit(0)).alias("status_code"),
        X.parse_ts(F.col("log.timestamp")).alias("timestamp"),
        F.coalesce("log.insertId", F.lit("")).alias("insert_id"),
        F.coalesce(labels + "project_id", F.lit("")).alias("project_id"),
        F.col(h + "userAgent").alias("user_agent"), F.col(h + "remoteIp").alias("remote_ip"),
        F.col("log.trace").alias("trace_id"), F.col("log.spanId").alias("span_id"),
        F.regexp_replace(h + "latency", "s+$", "").try_cast("double").alias("latency_seconds"),
        F.coalesce(F.col(h + "userAgent") == C.SCHEDULER_USER_AGENT, F.lit(False)).alias("is_scheduler_invoked"))


def parse_status(parsed: DataFrame) -> DataFrame:
    """Add ``status``: parsed, skipped (unknown format) or error (malformed, no readable time)."""
    timed = X.parse_ts(F.col("log.timestamp")).isNotNull()
    return parsed.withColumn(
        "status", F.when(F.col("log_format") == "malformed", "error")
        .when(F.col("log_format") == "unknown", "skipped")
        .when(timed, "parsed").otherwise("error"))


def quarantine(parsed: DataFrame) -> DataFrame:
    """Entries that could not be turned into a record."""
    return parse_status(parsed).where(F.col("status") == "error").drop("log")


def ingest_stats(parsed: DataFrame) -> DataFrame:
    return parse_status(parsed).groupBy("log_format", "status").agg(F.count(F.lit(1)).alias("n"))


def dedup_events(events: DataFrame, arrival: list[str], existing: DataFrame | None = None) -> DataFrame:
    """First arrival of each event id that is not stored yet.

    Spark keeps only the first row per id of each task before the shuffle, so
    many copies of one event cost little.
    """
    order = Window.partitionBy("event_id").orderBy(*arrival)
    first = events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")
    return first if existing is None else first.join(existing.select("event_id"), "event_id", "left_anti")
