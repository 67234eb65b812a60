"""Scalar expressions shared by ingestion, scoring and profiling."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowrisk import config as C


# --- time -------------------------------------------------------------------

def parse_ts(text: Column) -> Column:
    """ISO timestamp text to timestamp; digits after the sixth are cut off."""
    trimmed = F.regexp_replace(text, r"Z+$", "")
    return F.try_to_timestamp(F.regexp_replace(trimmed, r"(\.\d{6})\d+", "$1"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def floor_window(ts: Column, minutes: int) -> Column:
    """Start of the fixed-length window that holds ``ts``."""
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(minutes * 60)))


def time_slice(ts: Column, seconds: int) -> Column:
    """Number of the fixed-length time slice that holds ``ts``."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


# --- mapping and classification --------------------------------------------

def _first_match(rules, default: str) -> Column:
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def map_action(service: Column, method: Column) -> Column:
    return _first_match(
        [((service == svc) & method.contains(part), F.lit(action))
         for svc, part, action, _ in C.METHOD_ACTIONS], "OTHER")


def map_zone(service: Column, method: Column) -> Column:
    return _first_match(
        [((service == svc) & method.contains(part), F.lit(zone))
         for svc, part, _, zone in C.METHOD_ACTIONS], "DATA")


def resource_type(resource: Column) -> Column:
    return _first_match([(resource.contains(part), F.lit(kind)) for part, kind in C.RESOURCE_TYPES],
                        "OTHER")


def is_exfil_risk(resource: Column, action: Column) -> Column:
    """Data access that leaves for a public or external destination."""
    path_hit = F.lit(False)
    for path in C.EXFIL_PATHS:
        path_hit = path_hit | resource.contains(path)
    bucket = F.get(F.split(F.get(F.split(resource, "buckets/"), F.lit(1)), "/"), F.lit(0))
    bucket_hit = F.lit(False)
    for prefix in C.EXFIL_BUCKET_PREFIXES:
        bucket_hit = bucket_hit | F.coalesce(bucket.startswith(prefix), F.lit(False))
    return action.isin(C.EXFIL_ACTIONS) & (path_hit | bucket_hit)


def resolved_account(name: Column, project_id: str, project_number: str) -> Column:
    """An account name with PROJECT_ID and PROJECT_NUMBER filled in."""
    return F.replace(F.replace(name, F.lit("PROJECT_NUMBER"), F.lit(project_number)), F.lit("PROJECT_ID"), F.lit(project_id))


def actor_type(actor: Column) -> Column:
    return (F.when(actor.endswith(C.SERVICE_ACCOUNT_SUFFIX), "SERVICE_ACCOUNT")
            .when(actor == "unknown", "UNKNOWN").otherwise("HUMAN"))


def is_infrastructure(actor: Column) -> Column:
    out = F.lit(False)
    for suffix in C.INFRASTRUCTURE_SUFFIXES:
        out = out | actor.endswith(suffix)
    return out


def event_content_id(ts_text: Column, actor: Column, method: Column, resource: Column,
                     insert_id: Column) -> Column:
    """Stable 32-digit id from the content of a log entry."""
    parts = [F.coalesce(c, F.lit("")) for c in (ts_text, actor, method, resource, insert_id)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def provenance_source(actor: Column, trigger_ref: Column, known: Column) -> Column:
    """``known`` says whether the actor is a known initiator."""
    return (F.when(trigger_ref.isNull() | ~known, "UNKNOWN")
            .when(actor.endswith(C.SCHEDULER_ACCOUNT_SUFFIX), "CLOUD_SCHEDULER")
            .when(actor.endswith(C.BUILD_ACCOUNT_SUFFIX), "CLOUD_BUILD")
            .otherwise("UNKNOWN"))


def role_of(actor: Column) -> Column:
    """Text before ``-sa-`` in an actor name."""
    found = F.regexp_extract(actor, r"(?s)^(.+?)-sa-", 1)
    return F.when(found == "", "unknown").otherwise(found)


def value_type(value: Column) -> Column:
    """Semantic type of a string value, or null."""
    out = None
    for name, pattern in C.VALUE_PATTERNS:
        out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
    return out


def action_bit(action: Column) -> Column:
    """One bit per action type, so that sets of actions merge with ``bit_or``."""
    index = F.array_position(F.array(*[F.lit(a) for a in C.ACTION_TYPES]), action)
    index = F.when(index == 0, len(C.ACTION_TYPES)).otherwise(index)
    return F.call_function("shiftleft", F.lit(1).cast("long"), (index - 1).cast("int"))


def actions_of_bits(bits: Column) -> Column:
    """Sorted action names of a bit set."""
    names = F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(a))
                      for i, a in enumerate(C.ACTION_TYPES)])
    return F.array_sort(F.array_compact(names))


# --- numbers ----------------------------------------------------------------

def clip_unit(value: Column, bound: float) -> Column:
    """``value / bound`` held to [0, 1]."""
    if bound <= 0:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(value / F.lit(bound), F.lit(1.0)))


def fixed(value: Column, digits: int) -> Column:
    """Text of a number with up to three digits after the point, rounded as C, Python and SQL round it.

    The double itself is rounded, and a tie goes to the even digit. Spark's own format rounds the shortest decimal form
    half up: 1.25 to 1.3, and 1.15, which is less than that as a double, to 1.2.
    """
    unit, x = 10 ** digits, F.abs(value)
    scaled = x * float(unit)
    # What rounding took from the product: every difference on the way is of two numbers within a factor of two, so it is exact.
    missing = -scaled
    for power in (512, 256, 128, 64, 32, 16, 8, 4, 2, 1):
        if unit & power:
            missing = missing + x * float(power)
    whole = F.floor(scaled)
    over = scaled - whole
    up = (over > 0.5) | ((over == 0.5) & ((missing > 0) | ((missing == 0) & (whole % 2 == 1))))
    return F.format_string(f"%.{digits}f", F.signum(value) * (whole + up.cast("int")) / float(unit))


def sigmoid(value: Column, steepness: float = C.SIGMOID_STEEPNESS,
            midpoint: float = C.SIGMOID_MIDPOINT) -> Column:
    power = F.least(F.lit(500.0), F.greatest(F.lit(-500.0), (value - midpoint) * (-steepness)))
    return 1.0 / (1.0 + F.exp(power))


def tier(value: Column, bounds, inclusive: bool = True, default: str = "NORMAL") -> Column:
    """Label of the highest bound reached. ``bounds`` holds (label, number or Column)."""
    return _first_match(
        [(value >= bound if inclusive else value > bound, F.lit(label)) for label, bound in bounds],
        default)


def tier_rank(label: Column) -> Column:
    return (F.when(label.isin("HIGH", "ALERT_HIGH"), 3).when(label.isin("MEDIUM", "ALERT_MED"), 2)
            .when(label == "WATCH", 1).otherwise(0))


def half_even_rank(count: Column, p: float) -> Column:
    """Zero-based nearest rank with halves going to the even number."""
    return F.least(count - 1, F.bround((count - 1) * F.lit(p), 0).cast("long"))


# --- sequences --------------------------------------------------------------

# The LCS of a long sequence and a short pattern is kept as one bit vector per
# pattern start: after reading the sequence, the zero bits among the low j bits
# of the vector for start i number LCS(sequence, pattern[i .. i + j)).

WORD_BITS = 60  # so that bit sums stay inside a long; longer patterns use rows of numbers


def symbol_masks(pattern: Column) -> Column:
    """Map of each pattern symbol to the bits of its positions."""
    places = F.sequence(F.lit(1), F.size(pattern))
    one = F.lit(1).cast("long")
    return F.map_from_entries(F.transform(F.array_distinct(pattern), lambda c: F.struct(
        c.alias("symbol"),
        F.aggregate(places, F.lit(0).cast("long"), lambda acc, j: acc + F.when(
            F.element_at(pattern, j) == c, F.call_function("shiftleft", one, j - 1))
            .otherwise(F.lit(0).cast("long"))).alias("mask"))))


def low_bits(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1


def lcs_vector(masks: Column, length: Column, start: Column | None = None) -> Column:
    """Bit vector of a sequence given as pattern masks, for the pattern from ``start`` on."""
    whole = low_bits(length if start is None else length - start)
    mask = (lambda m: m) if start is None else (lambda m: F.call_function("shiftright", m, start))

    def step(v, m):
        hit = v.bitwiseAND(mask(m))
        return (v + hit).bitwiseOR(v - hit).bitwiseAND(whole)

    return F.aggregate(masks, whole, step)


def lcs_masks(symbols: Column, table: Column) -> Column:
    """Masks of the symbols that the pattern has; the others cannot matter."""
    return F.filter(F.transform(symbols, lambda c: F.try_element_at(table, c)), lambda m: m.isNotNull())


def lcs_vectors(masks: Column, length: Column) -> Column:
    """Vectors for every pattern start: enough to join chunks exactly."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: lcs_vector(masks, length, i))


def lcs_of_vector(vector: Column, length: Column) -> Column:
    return length - F.bit_count(vector.bitwiseAND(low_bits(length)))


def lcs_join(chunks: Column, length: Column) -> Column:
    """LCS of a long sequence from the ordered vectors of its chunks."""
    start = F.transform(F.sequence(F.lit(0), length), lambda _: F.lit(0))

    def reach(best, vectors, j):
        longer = F.transform(F.sequence(F.lit(0), j), lambda i: F.get(best, i) + F.when(
            i < j, lcs_of_vector(F.get(vectors, i), j - i)).otherwise(0))
        return F.array_max(longer)

    best = F.aggregate(chunks, start, lambda row, vectors: F.transform(
        F.sequence(F.lit(0), length), lambda j: reach(row, vectors, j)))
    return F.get(best, length)


def last_positions(pattern: Column) -> Column:
    """Map of each pattern symbol to its last position at or before each position; 0 where there is none."""
    places = F.sequence(F.lit(1), F.size(pattern))
    at_or_before = lambda c, j: F.array_max(F.filter(F.sequence(F.lit(1), j), lambda k: F.element_at(pattern, k) == c))
    return F.map_from_entries(F.transform(F.array_distinct(pattern), lambda c: F.struct(
        c.alias("symbol"), F.transform(places, lambda j: F.coalesce(at_or_before(c, j), F.lit(0))).alias("last"))))


def lcs_row(lasts: Column, length: Column, start: Column | None = None) -> Column:
    """LCS of a sequence, given as :func:`last_positions` of its symbols, with each pattern[start .. j)."""
    from_ = F.lit(0) if start is None else start
    zero = F.transform(F.sequence(F.lit(0), length), lambda _: F.lit(0))

    def step(row, last):
        def cell(v, j):
            at = F.get(last, j - 1)
            return F.when((j > from_) & (at > from_), F.greatest(v, F.get(row, at - 1) + 1)).otherwise(v)
        return F.transform(row, cell)

    return F.aggregate(lasts, zero, step)


def lcs_rows(lasts: Column, length: Column) -> Column:
    """Rows for every pattern start."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: lcs_row(lasts, length, i))


def lcs_rows_join(chunks: Column, length: Column) -> Column:
    """LCS of a long sequence from the ordered rows of its chunks."""
    zero = F.transform(F.sequence(F.lit(0), length), lambda _: F.lit(0))

    def reach(best, rows, j):
        return F.array_max(F.transform(F.sequence(F.lit(0), j), lambda i: F.get(best, i) + F.when(
            i < j, F.get(F.get(rows, i), j)).otherwise(0)))

    best = F.aggregate(chunks, zero, lambda row, rows: F.transform(
        F.sequence(F.lit(0), length), lambda j: reach(row, rows, j)))
    return F.get(best, length)


# --- keyed hashing ----------------------------------------------------------

def seed_salt(seed: int) -> str:
    return hashlib.sha256(str(seed).encode()).hexdigest()[:32]


def hmac_pads(salt: str) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA256 for a key of at most 64 bytes."""
    key = salt.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(text: Column, salt: str) -> Column:
    """HMAC-SHA256 of a text column, as hex, from the built-in ``sha2``."""
    inner, outer = hmac_pads(salt)
    digest = F.sha2(F.concat(F.lit(bytearray(inner)), text.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(digest)), 256)
