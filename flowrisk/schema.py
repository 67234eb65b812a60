"""Schemas of raw logs and canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One schema covers the three log formats, so each entry is parsed once.
LOG_ENTRY = """
timestamp string, insertId string, logName string, trace string, spanId string,
metadata struct<trigger_ref: string>,
resource struct<type: string, labels: struct<project_id: string, location: string, job_id: string,
  service_name: string, configuration_name: string, revision_name: string>>,
httpRequest struct<requestUrl: string, status: string, userAgent: string, remoteIp: string, latency: string>,
jsonPayload struct<`@type`: string, jobName: string, scheduledTime: string, url: string,
  targetType: string, status: string, debugInfo: string>,
protoPayload struct<`@type`: string, serviceName: string, methodName: string, resourceName: string,
  authenticationInfo: struct<principalEmail: string,
    serviceAccountDelegationInfo: array<struct<firstPartyPrincipal: struct<principalEmail: string>>>>,
  status: struct<code: string>>,
_corrupt_record string
"""

CANONICAL_EVENT = """
event_id string, ts timestamp, window_start timestamp, actor_id string, actor_type string,
actor_subtype string, orchestrator_id string, trigger_ref string, provenance_level string,
provenance_source string, action_type string, action_subtype string, tool_name string,
tool_parameters_hash string, model_id string, target_id string, target_type string,
target_zone string, correlation_confidence double, delegation_chain array<string>, result string,
project_id string, env string, is_deploy boolean, is_incident boolean, is_infrastructure boolean,
risk_tags array<string>, raw_ref string, coverage_flag boolean
"""

# Defaults of canonical columns a source does not set.
DEFAULTS = {
    "provenance_level": "NONE",
    "provenance_source": "UNKNOWN", "correlation_confidence": 0.0, "result": "SUCCESS",
    "env": "sandbox", "is_deploy": False, "is_incident": False, "is_infrastructure": False,
    "coverage_flag": True,
}


def as_canonical(df: DataFrame) -> DataFrame:
    """Select the canonical columns in order, filling in those that ``df`` lacks."""
    out = []
    for column in CANONICAL_EVENT.strip().split(","):
        name, kind = column.split()
        if name in df.columns:
            value = F.col(name)
        elif kind.startswith("array"):
            value = F.array()
        else:
            value = F.lit(DEFAULTS.get(name))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)
