"""Every constant and tunable of the library in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. They define what the results mean and must stay as they are.
# ---------------------------------------------------------------------------

ACTION_TYPES = [
    "IAM_SET_POLICY", "IAM_CREATE_SA", "IAM_CREATE_KEY", "IAM_DELETE_KEY",
    "IAM_IMPERSONATE", "SECRET_ACCESS", "SECRET_ADMIN", "KMS_DECRYPT",
    "KMS_ENCRYPT", "GCS_READ", "GCS_WRITE", "GCS_LIST", "BQ_JOB_SUBMIT",
    "COMPUTE_CREATE", "COMPUTE_METADATA_CHANGE", "SCHEDULER_ADMIN",
    "AGENT_TOOL_CALL", "OTHER",
]

# Zone order fixes the row and column numbers of the flux matrix.
ZONES = ["CONTROL", "IDENTITY", "SECRET", "DATA", "COMPUTE", "EXFIL_RISK"]

ZONE_WEIGHTS = {
    "SECRET": 2.0, "EXFIL_RISK": 2.0, "IDENTITY": 1.5, "CONTROL": 1.5,
    "DATA": 1.0, "COMPUTE": 1.0,
}

PROVENANCE_RANK = {"NONE": 0, "WEAK": 1, "STRONG": 2}

# (service, method substring, action, zone); the first match wins.
METHOD_ACTIONS = [
    ("iam.googleapis.com", "CreateServiceAccountKey", "IAM_CREATE_KEY", "IDENTITY"),
    ("iam.googleapis.com", "DeleteServiceAccountKey", "IAM_DELETE_KEY", "IDENTITY"),
    ("iam.googleapis.com", "CreateServiceAccount", "IAM_CREATE_SA", "IDENTITY"),
    ("iam.googleapis.com", "serviceAccounts.actAs", "IAM_IMPERSONATE", "IDENTITY"),
    ("iam.googleapis.com", "SetIAMPolicy", "IAM_SET_POLICY", "CONTROL"),
    ("iam.googleapis.com", "SetIamPolicy", "IAM_SET_POLICY", "CONTROL"),
    ("iamcredentials.googleapis.com", "GenerateAccessToken", "IAM_IMPERSONATE", "IDENTITY"),
    ("iamcredentials.googleapis.com", "GenerateIdToken", "IAM_IMPERSONATE", "IDENTITY"),
    ("secretmanager.googleapis.com", "AddSecretVersion", "SECRET_ADMIN", "SECRET"),
    ("secretmanager.googleapis.com", "CreateSecret", "SECRET_ADMIN", "SECRET"),
    ("secretmanager.googleapis.com", "AccessSecretVersion", "SECRET_ACCESS", "SECRET"),
    ("cloudkms.googleapis.com", "Decrypt", "KMS_DECRYPT", "SECRET"),
    ("cloudkms.googleapis.com", "Encrypt", "KMS_ENCRYPT", "SECRET"),
    ("storage.googleapis.com", "storage.objects.list", "GCS_LIST", "DATA"),
    ("storage.googleapis.com", "storage.objects.get", "GCS_READ", "DATA"),
    ("storage.googleapis.com", "storage.objects.create", "GCS_WRITE", "DATA"),
    ("bigquery.googleapis.com", "jobservice.insert", "BQ_JOB_SUBMIT", "DATA"),
    ("compute.googleapis.com", "instances.insert", "COMPUTE_CREATE", "COMPUTE"),
    ("compute.googleapis.com", "setMetadata", "COMPUTE_METADATA_CHANGE", "COMPUTE"),
    ("compute.googleapis.com", "setLabels", "COMPUTE_METADATA_CHANGE", "COMPUTE"),
    ("run.googleapis.com", "SetIamPolicy", "IAM_SET_POLICY", "CONTROL"),
    ("run.googleapis.com", "CreateService", "COMPUTE_CREATE", "COMPUTE"),
    ("cloudscheduler.googleapis.com", "CreateJob", "SCHEDULER_ADMIN", "CONTROL"),
    ("cloudresourcemanager.googleapis.com", "SetIamPolicy", "IAM_SET_POLICY", "CONTROL"),
]

# (resource substring, target type); the first match wins.
RESOURCE_TYPES = [
    ("serviceAccounts", "SERVICE_ACCOUNT"),
    ("keys/", "SA_KEY"),
    ("secrets/", "SECRET"),
    ("cryptoKeys/", "KMS_KEY"),
    ("buckets/", "GCS_BUCKET"),
    ("bigquery", "BIGQUERY"),
    ("instances/", "COMPUTE"),
    ("IamPolicy", "IAM_POLICY"),
]

EXFIL_ACTIONS = ["GCS_READ", "GCS_WRITE", "GCS_LIST", "BQ_JOB_SUBMIT"]
EXFIL_PATHS = [
    "storage.googleapis.com/public-",
    "storage.googleapis.com/external-",
    "bigquery.googleapis.com/projects/public-",
]
EXFIL_BUCKET_PREFIXES = ["external-", "public-"]

INFRASTRUCTURE_SUFFIXES = ["@gcp-sa-logging.iam.gserviceaccount.com"]
SERVICE_ACCOUNT_SUFFIX = ".gserviceaccount.com"
SCHEDULER_ACCOUNT_SUFFIX = "@gcp-sa-cloudscheduler.iam.gserviceaccount.com"
BUILD_ACCOUNT_SUFFIX = "@cloudbuild.gserviceaccount.com"

SCHEDULER_TYPE_PREFIX = "type.googleapis.com/google.cloud.scheduler.logging."
REQUEST_LOG_MARKER = "run.googleapis.com%2Frequests"
SCHEDULER_USER_AGENT = "Google-Cloud-Scheduler"

LOG_PREFIXES = [
    "cloudaudit.googleapis.com/activity",
    "cloudaudit.googleapis.com/data_access",
    "cloudaudit.googleapis.com/system_event",
    "cloudscheduler.googleapis.com",
    "run.googleapis.com",
]

# (rule id, severity)
INVARIANT_SEVERITY = {
    "INV_001": 5, "INV_002": 5, "INV_003": 5, "INV_004": 4, "INV_005": 5,
    "INV_006": 5, "INV_007": 5, "INV_008": 4, "INV_009": 5, "INV_010": 5,
    "INV_011": 5,
}

FUSION_WEIGHTS = {
    "inv_score": 0.17, "inv_count": 0.13, "novelty_score": 0.30,
    "sigma_coarse": 0.04, "bridge_new": 0.13, "delta_f": 0.08,
    "closure_gap": 0.10, "orphaned_priv": 0.05, "burst_per_min": 0.00,
    "breadth_entropy": 0.00,
}
FUSION_BOUNDS = {
    "inv_score": 5.0, "inv_count": 10.0, "novelty_score": 10.0,
    "bridge_new": 5.0, "delta_f": 5.0, "orphaned_priv": 50.0,
    "burst_per_min": 20.0, "breadth_entropy": 4.0,
}
SIGMOID_STEEPNESS = 1.0
SIGMOID_MIDPOINT = 3.0

PATTERN_WEIGHTS = {"actor": 0.30, "zone": 0.35, "time": 0.20, "rate": 0.15}
PROVENANCE_MULTIPLIERS = {"STRONG": 1.0, "WEAK": 0.6, "NONE": 0.0}
WEAK_RESOLVED_MULTIPLIER = 0.8
DISCOUNT_WEIGHT = 0.3

CORRELATION_WEIGHTS = {"identity": 0.4, "url": 0.3, "ambiguity": 0.2, "temporal": 0.1}
DEFAULT_CADENCE_SECONDS = 300.0

# Four threshold sets, highest first: (label, bound). They differ on purpose.
RESIDUAL_TIERS = [("HIGH", 0.45), ("MEDIUM", 0.34), ("WATCH", 0.20)]
FUSION_TIERS = [("HIGH", 0.8), ("MEDIUM", 0.5), ("WATCH", 0.005)]
ENERGY_TIERS = [("ALERT_HIGH", 8.0), ("ALERT_MED", 5.0), ("WATCH", 3.0)]  # strict bounds
GATE_PASS, GATE_BORDERLINE = 0.80, 0.60

POLICY_ACTIONS = {
    "ALERT_HIGH": "ISOLATE_ACTOR",
    "ALERT_MED": "REQUEST_REVIEW",
    "WATCH": "INCREASE_MONITORING",
}

# Ordered value patterns of the log profiler; the first match wins.
VALUE_PATTERNS = [
    ("email", r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"),
    ("ipv4", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
    ("ipv6", r"^[0-9a-fA-F:]{3,}$"),
    ("uri", r"^(https?://|gs://|s3://|projects/|arn:)"),
    ("iso_timestamp", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("hex_hash", r"^[0-9a-fA-F]{16,}$"),
]

SIGNALS = ["inv_score", "novelty_score", "sigma_coarse", "bridge_new",
           "delta_f", "closure_gap", "orphaned_priv"]

# Words that give a label away in released data; callers pass the names their own data uses.
LEAK_VOCABULARY = ["attack", "anomaly", "benign", "campaign", "exfil", "is_attack", "label", "malicious", "secret"]


# ---------------------------------------------------------------------------
# Tunables
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class WorldConfig:
    """Windowing and history lengths."""

    window_minutes: int = 15
    lookback_days: int = 30
    ema_days: int = 90
    ema_alpha: float = 0.1
    cold_observations: int = 5
    warm_observations: int = 50
    # Width of the time slices over which one busy actor or target is spread.
    slice_minutes: int = 60

    @property
    def window_seconds(self) -> int:
        return self.window_minutes * 60

    @property
    def lookback_seconds(self) -> int:
        return self.lookback_days * 86400

    @property
    def slice_seconds(self) -> int:
        return self.slice_minutes * 60


@dataclass(frozen=True)
class ClosureConfig:
    """What opens a watch on a resource and what closes it. The defaults are fixed values as well."""

    pairs: tuple = (
        # (pair_id, opening action, closing action, hours, tier)
        ("seed-iam-create-key", "IAM_CREATE_KEY", "IAM_DELETE_KEY", 720, 1),
        ("seed-iam-create-sa", "IAM_CREATE_SA", "IAM_DELETE_SA", 720, 1),
    )
    temporal_ttl: dict = field(default_factory=lambda: {"IAM_IMPERSONATE": 1})
    opening_types: tuple = (
        "IAM_CREATE_KEY", "IAM_CREATE_SA", "IAM_IMPERSONATE", "IAM_SET_POLICY",
        "COMPUTE_METADATA_CHANGE",
    )
    resource_types: dict = field(default_factory=lambda: {
        "IAM_CREATE_KEY": "SA_KEY", "IAM_CREATE_SA": "SERVICE_ACCOUNT",
        "IAM_IMPERSONATE": "IMPERSONATION", "IAM_SET_POLICY": "IAM_POLICY",
        "SECRET_ADMIN": "SECRET", "COMPUTE_METADATA_CHANGE": "COMPUTE",
    })
    sensitivity: dict = field(default_factory=lambda: {
        "SA_KEY": 5.0, "SERVICE_ACCOUNT": 4.0, "IMPERSONATION": 4.0,
        "IAM_POLICY": 4.0, "SECRET": 3.0, "COMPUTE": 2.0, "UNKNOWN": 3.0,
    })
    settlement_hours: dict = field(default_factory=lambda: {
        "IMPERSONATION": 1, "IAM_POLICY": 4, "COMPUTE": 2, "SECRET": 4, "UNKNOWN": 4,
    })
    never_settle: tuple = ("SA_KEY", "SERVICE_ACCOUNT")
    failsafe_zones: tuple = ("IDENTITY", "CONTROL")
    mining_extra_zones: tuple = ("SECRET",)
    default_settlement_hours: int = 4
    default_window_hours: int = 24
    max_gap_hours: int = 720
    min_observations: int = 3
    promote_observations: int = 5


@dataclass(frozen=True)
class CorrelationConfig:
    """Join tolerances of the log correlator, in seconds."""

    link_seconds: int = 60
    audit_seconds: int = 120
    # Width of the time slices over which a busy project is spread.
    slice_seconds: int = 3600
