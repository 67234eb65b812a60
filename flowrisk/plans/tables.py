"""Views of the benchmark tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.config import WorldConfig
from flowrisk.functions import expressions as X

# Day windows and a week of lookback suit a table that spans one month.
DAY = WorldConfig(window_minutes=1440, lookback_days=7)

SCHEDULER_INITIATOR = "service-1@gcp-sa-cloudscheduler.iam.gserviceaccount.com"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with the number of its JSON property."""
    return (table(spark, sf_dir, "events")
            .withColumn("k", F.get_json_object("props", "$.k").cast("int")))


def canonical_events(spark: SparkSession, sf_dir: str, cfg: WorldConfig = DAY) -> DataFrame:
    """The events table as canonical audit events."""
    kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
    suffix = F.when(user % 2 == 0, "@p.iam.gserviceaccount.com").otherwise("@example.com")
    action = (F.when(kind == "signup", F.when(k < 20, "IAM_CREATE_KEY").when(k < 40, "IAM_DELETE_KEY")
                     .otherwise("IAM_IMPERSONATE"))
              .when(kind == "click", F.when(k < 20, "IAM_SET_POLICY")
                    .when(k < 40, "COMPUTE_METADATA_CHANGE").otherwise("COMPUTE_CREATE"))
              .when(kind == "purchase", F.when(k < 70, "SECRET_ACCESS").otherwise("KMS_DECRYPT"))
              .when(kind == "view", "GCS_READ")
              .otherwise(F.when(k < 50, "GCS_WRITE").otherwise("BQ_JOB_SUBMIT")))
    zone = (F.when(kind == "signup", "IDENTITY")
            .when(kind == "click", F.when(k < 20, "CONTROL").otherwise("COMPUTE"))
            .when(kind == "purchase", "SECRET").when(kind == "view", "DATA")
            .otherwise(F.when(k < 50, "EXFIL_RISK").otherwise("DATA")))
    target = (F.when(kind == "signup", F.concat_ws("/", F.lit("sa"), user, k % 5))
              .otherwise(F.concat_ws("/", F.col("target_zone"), user % 50, k % 10)))
    trigger = (F.when(user % 3 == 0, F.concat(F.lit("projects/p/locations/l/jobs/"), user % 7))
               .when(user % 3 == 1, F.concat(F.lit("sched:j"), user % 7, F.lit(":0"))))
    return (raw_events(spark, sf_dir)
            .withColumn("actor_id", F.concat(F.lit("u"), user, suffix))
            .withColumn("action_type", action)
            .withColumn("target_zone", zone)
            .withColumn("target_id", target)
            .withColumn("trigger_ref", trigger)
            .select(
                F.format_string("%012d", "event_id").alias("event_id"), "ts",
                X.floor_window(F.col("ts"), cfg.window_minutes).alias("window_start"),
                "actor_id", X.actor_type(F.col("actor_id")).alias("actor_type"), "action_type",
                "target_id", "target_zone", "trigger_ref",
                F.when(F.col("trigger_ref").isNotNull(), "WEAK").otherwise("NONE").alias("provenance_level"),
                X.provenance_source(F.col("actor_id"), F.col("trigger_ref"), user % 6 == 0)
                .alias("provenance_source"),
                F.when((user % 4 == 0) & (k < 90), F.array(F.lit("d")))
                .otherwise(F.array().cast("array<string>")).alias("delegation_chain"),
                F.lit(False).alias("is_deploy"), F.lit("p").alias("project_id"),
                F.col("user_id"), F.col("event_type"), F.col("value")))


def known_initiators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth user, plus one scheduler account."""
    users = (table(spark, sf_dir, "events").where(F.col("user_id") % 6 == 0)
             .select(F.concat(F.lit("u"), "user_id", F.lit("@p.iam.gserviceaccount.com")).alias("actor_id"))
             .distinct())
    return users.unionByName(spark.createDataFrame([(SCHEDULER_INITIATOR,)], "actor_id string"))


PATTERN_ROWS = [
    # id, registered, actors, zones, days, hour from, hour to, rate min, rate max
    ("pat-a", 3, [], ["SECRET", "DATA"], None, None, None, 0.0, 0.0),
    ("pat-b", 2, ["u6@other.com", "", "u12@p.iam.gserviceaccount.com"],
     ["DATA", "SECRET", "COMPUTE", "IDENTITY"], [0, 1, 2, 3, 4], 0, 12, 1.0, 3.0),
    ("pat-c", 1, [], [], [5, 6], 0, 24, 2.0, 5.0),
]


def patterns(spark: SparkSession) -> DataFrame:
    rows = [(i, f"2024-01-0{r} 00:00:00", a, z,
             None if d is None else {"days_of_week": d, "hour_start": h0, "hour_end": h1}, lo, hi, True)
            for i, r, a, z, d, h0, h1, lo, hi in PATTERN_ROWS]
    schema = ("pattern_id string, registered string, expected_actors array<string>, "
              "expected_zones array<string>, "
              "expected_window struct<days_of_week:array<int>,hour_start:int,hour_end:int>, "
              "rate_min double, rate_max double, active boolean")
    return (spark.createDataFrame(rows, schema)
            .withColumn("registered_ts", F.to_timestamp("registered")).drop("registered"))


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth user has a labelled interval: the three days from its first event."""
    return (table(spark, sf_dir, "events").where(F.col("user_id") % 10 == 0)
            .groupBy("user_id").agg(F.min("ts").alias("_t"))
            .select(F.concat(F.lit("u"), "user_id").alias("actor"),
                    (F.unix_micros("_t") / F.lit(1e6)).alias("t_start"),
                    (F.unix_micros("_t") / F.lit(1e6) + 3 * 86400).alias("t_end"),
                    F.concat(F.lit("f"), (F.col("user_id") / 10).cast("long") % 5).alias("flavor")))


# --- raw log entries built from the events table ---------------------------------

RESOURCES = [
    "projects/p/serviceAccounts/a", "projects/p/serviceAccounts/a/keys/", "projects/p/secrets/s",
    "projects/p/cryptoKeys/c", "projects/_/buckets/external-b/objects/o", "projects/_/buckets/inner/objects/o",
    "bigquery.googleapis.com/projects/public-x/d", "zones/z/instances/i",
]


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON log entries: signups are scheduler runs, clicks are service requests, the
    rest audit records. Some errors lack a time and some are cut off in the middle."""
    from flowrisk import config as C

    e = raw_events(spark, sf_dir)
    kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("123Z"))
    timeless = (kind == "error") & (k < 5)
    index = (user * 7 + k) % (len(C.METHOD_ACTIONS) + 2)
    method = F.get(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m")) for s, m, _, _ in C.METHOD_ACTIONS]),
                   index.cast("int"))
    resource = F.concat(F.get(F.array(*[F.lit(r) for r in RESOURCES]), ((user + k) % 9).cast("int")), k % 5)
    actor = (F.when(user % 5 == 1, F.concat(F.lit("svc"), user, F.lit("@gcp-sa-logging.iam.gserviceaccount.com")))
             .when(user % 5 == 2, F.concat(F.lit("w"), user, F.lit("@p.iam.gserviceaccount.com")))
             .when(user % 5 > 2, F.concat(F.lit("h"), user, F.lit("@example.com"))))
    email = lambda c: F.struct(F.struct(c.alias("principalEmail")).alias("firstPartyPrincipal"))
    chain = F.when(user % 4 == 0, F.array(email(F.lit("d1")), email(F.lit("")), email(F.lit(None).cast("string"))))
    audit = F.struct(
        F.lit("type.googleapis.com/google.cloud.audit.AuditLog").alias("@type"),
        F.coalesce(method["s"], F.lit("other.googleapis.com")).alias("serviceName"),
        F.concat(F.lit("v1."), F.coalesce(method["m"], F.lit("Foo"))).alias("methodName"),
        resource.alias("resourceName"),
        F.struct(actor.alias("principalEmail"), chain.alias("serviceAccountDelegationInfo")).alias("authenticationInfo"),
        F.struct(F.when(k % 7 == 0, 7).alias("code")).alias("status"))
    job = F.concat(F.lit("j"), user % 7)
    run = F.struct(
        F.concat(F.lit(C.SCHEDULER_TYPE_PREFIX), F.when(k < 80, "AttemptStarted").otherwise("AttemptFinished")).alias("@type"),
        F.concat(F.lit("projects/p/locations/l/jobs/"), job).alias("jobName"),
        F.when(k < 80, stamp).alias("scheduledTime"), F.concat(F.lit("https://s"), user % 3, F.lit("/")).alias("url"))
    http = (F.when(kind == "click", F.struct(
        F.concat(F.lit("https://s"), user % 3).alias("requestUrl"), F.lit(200).alias("status"),
        F.when(k < 80, C.SCHEDULER_USER_AGENT).otherwise("curl").alias("userAgent"),
        F.concat(F.lit("0."), F.lpad(k.cast("string"), 3, "0"), F.lit("s")).alias("latency")))
        .when((kind == "signup") & (k >= 80), F.struct(
            F.lit(None).cast("string").alias("requestUrl"), F.lit(500).alias("status"),
            F.lit(None).cast("string").alias("userAgent"), F.lit(None).cast("string").alias("latency"))))
    labels = F.struct(
        F.concat(F.lit("p"), user % 2).alias("project_id"),
        F.when((kind == "signup") & (k % 2 == 0), job).alias("job_id"),
        F.when(kind == "click", F.concat(F.lit("s"), user % 3)).alias("service_name"))
    log = F.when(kind == "signup", "projects/p/logs/cloudscheduler.googleapis.com%2Fexecutions") \
        .when(kind == "click", "projects/p/logs/run.googleapis.com%2Frequests") \
        .otherwise("projects/p/logs/cloudaudit.googleapis.com%2Factivity")
    body = F.to_json(F.struct(
        F.when(~timeless, stamp).alias("timestamp"), F.concat(F.lit("i"), "event_id").alias("insertId"), log.alias("logName"),
        F.when(user % 3 == 0, F.struct(F.concat(F.lit("projects/p/locations/l/jobs/"), user % 7).alias("trigger_ref")))
        .alias("metadata"),
        F.struct(labels.alias("labels")).alias("resource"), http.alias("httpRequest"),
        F.when(kind == "signup", run).alias("jsonPayload"),
        F.when(~kind.isin("signup", "click"), audit).alias("protoPayload")))
    cut = (kind == "error") & k.isin(5, 6)
    return e.select("event_id", "event_type", "k", "user_id",
                    F.when(cut, F.substring(body, 1, 40)).otherwise(body).alias("entry"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries as lines of text files, in the layouts a log export may have."""
    k = F.col("k")
    line = (F.when(k % 5 == 0, F.concat(F.lit("["), "entry", F.lit("]")))
            .when(k % 5 == 1, F.concat(F.lit("  "), "entry", F.lit(",")))
            .when(k % 5 == 2, F.concat("entry", F.lit("\nnot json\n"), "entry"))
            .when(k % 5 == 3, F.concat(F.lit("["), "entry", F.lit(", 7, "), "entry", F.lit("]")))
            .otherwise(F.col("entry")))
    path = F.concat(F.lit("/logs/"), F.when(F.col("event_type") == "click", "run.googleapis.com")
                    .otherwise("cloudaudit.googleapis.com/activity"), F.lit("/part.jsonl"))
    return raw_entries(spark, sf_dir).select(path.alias("source_file"), line.alias("value"))


# --- correlation inputs ------------------------------------------------------------

def scheduler_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return raw_events(spark, sf_dir).where(F.col("event_type") == "signup").select(
        F.concat(F.lit("p"), user % 2).alias("project_id"), F.concat(F.lit("j"), user % 7).alias("job_id"),
        F.concat(F.lit("https://s"), user % 3, F.lit("/")).alias("target_url"),
        F.lit("AttemptStarted").alias("attempt_type"), F.col("ts").alias("scheduled_time"),
        F.format_string("%012d", "event_id").alias("insert_id"))


def service_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return raw_events(spark, sf_dir).where(F.col("event_type") == "click").select(
        F.concat(F.lit("p"), user % 2).alias("project_id"), F.concat(F.lit("s"), user % 3).alias("service_name"),
        F.concat(F.lit("https://s"), user % 3).alias("request_url"), F.col("ts").alias("timestamp"),
        F.format_string("%012d", "event_id").alias("insert_id"),
        (F.col("k") < 80).alias("is_scheduler_invoked"), "k")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).where(F.col("event_type") == "purchase").select(
        F.format_string("%012d", "event_id").alias("event_id"), "ts",
        F.concat(F.lit("w"), F.col("user_id") % 4).alias("actor_id"))


def request_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed link for every invoked request, scheduled k minutes earlier."""
    return service_requests(spark, sf_dir).where("is_scheduler_invoked").select(
        "project_id", F.concat(F.lit("r"), "insert_id").alias("scheduler_id"), F.col("insert_id").alias("request_id"),
        (F.col("k") % 2 == 0).alias("url_match"), F.concat(F.lit("j"), F.col("k") % 7).alias("job_id"),
        F.timestamp_micros(F.unix_micros("timestamp") - F.col("k").cast("long") * 60_000_000).alias("scheduled_time"),
        "service_name", F.col("timestamp").alias("request_ts"))


def service_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s0", "w0"), ("s1", "w1"), ("s2", "w2"), ("s9", "w9")],
                                 "service_name string, worker string")


# --- trajectories -------------------------------------------------------------------

def state_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir).select(
        F.concat(F.lit("u"), "user_id").alias("actor"), (F.unix_micros("ts") / F.lit(1e6)).alias("t"),
        F.col("event_id").alias("seq"), F.col("target_id").alias("state"), F.col("event_type").alias("action"))


# --- log entries of unknown structure -------------------------------------------------

def mixed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, orders and conversation turns as JSON entries of three log types."""
    e = raw_events(spark, sf_dir)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    mail = lambda c: F.concat(F.lit("u"), c, F.lit("@example.com"))
    events = e.select(F.concat(F.lit("e"), "event_id").alias("id"), "ts", F.to_json(F.struct(
        F.lit("projects/p/logs/events").alias("logName"), iso("ts").alias("timestamp"),
        F.struct(mail(F.col("user_id")).alias("email"), F.array("user_id", "k").alias("ids")).alias("actor"),
        F.concat(F.lit("projects/p/x/"), F.col("k") % 10).alias("resource"), F.col("event_type").alias("kind")))
        .alias("entry"))
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.to_json(F.struct(
            F.lit("projects/p/logs/orders").alias("logName"),
            F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"),
                     F.col("o_orderpriority").alias("priority")).alias("order"),
            iso("o_orderdate").alias("createTime"), mail(F.col("o_custkey")).alias("customer"))).alias("entry"))
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), F.lit(None).cast("timestamp").alias("ts"),
        F.to_json(F.struct(F.struct(F.col("conv_id").alias("id"), F.col("turn")).alias("conv"), "role", "text"))
        .alias("entry"))
    return events.unionByName(orders).unionByName(turns)
