import sys
from datetime import timedelta
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE.parent), str(HERE)]

from shared import T0  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from flowrisk.session import local_session
    return local_session(4, partitions=4, app="tests")


@pytest.fixture(scope="session")
def make_events(spark):
    """Canonical events from short tuples (minute offset, actor, action, zone, target, extra)."""
    from flowrisk.functions import expressions as X
    from flowrisk.schema import as_canonical
    from pyspark.sql import functions as F

    def build(rows, minutes=15):
        data = []
        for i, row in enumerate(rows):
            at, actor, action, zone, target, *rest = row
            extra = rest[0] if rest else {}
            data.append((extra.get("event_id", f"e{i:04d}"), T0 + timedelta(minutes=at), actor, action, zone, target,
                         extra.get("delegation_chain", []), extra.get("trigger_ref"),
                         extra.get("provenance_level", "NONE"), extra.get("is_deploy", False)))
        df = spark.createDataFrame(data, "event_id string, ts timestamp, actor_id string, action_type string, "
                                         "target_zone string, target_id string, delegation_chain array<string>, "
                                         "trigger_ref string, provenance_level string, is_deploy boolean")
        return as_canonical(df.withColumn("window_start", X.floor_window(F.col("ts"), minutes)))
    return build
