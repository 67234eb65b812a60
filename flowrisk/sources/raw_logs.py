"""Scanning raw JSON logs, batch and incremental."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk import config as C

PATTERN = "*.{json,jsonl}"


def scan_logs(spark: SparkSession, path: str, prefixes: list[str] | None = None,
              whole_files: bool = False, marks: dict[str, str] | None = None, pattern: str = PATTERN) -> DataFrame:
    """Log entries below ``path``: (source_file, entry), one JSON object each.

    Lines are read one by one, so large files split over tasks. A line may hold
    an object or an array of objects, and the brackets and commas of an array
    with one object per line are taken off. ``whole_files`` reads each file as
    one text instead, for arrays whose objects span lines. ``marks`` holds the
    last path read of each source; files up to it are not opened.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    raw = reader.text(path, wholetext=whole_files)
    if marks:
        raw = raw.where(past_marks(F.col("_metadata.file_path"), marks))
    raw = raw.select(F.col("_metadata.file_path").alias("source_file"), F.col("value"))
    return split_entries(select_prefixes(raw, prefixes))


def past_marks(path: Column, marks: dict[str, str]) -> Column:
    """Whether a file lies past the mark of its source. Only literals, so that the file listing is pruned."""
    out = F.lit(True)
    for source, last in marks.items():
        out = out & (~path.contains(source) | (path > last))
    return out


def latest_files(spark: SparkSession, path: str, sources: list[str], pattern: str = PATTERN) -> dict[str, str]:
    """The last path of each source, from the listing alone."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
             .load(path).select(F.col("_metadata.file_path").alias("path")))
    last = files.agg(*[F.max(F.when(F.col("path").contains(s), F.col("path"))) for s in sources]).first()
    return {s: p for s, p in zip(sources, last) if p is not None}


def ingest_new(spark: SparkSession, path: str, events_path: str, marks: dict[str, str] | None = None,
               prefixes: list[str] = C.LOG_PREFIXES, pattern: str = PATTERN) -> tuple[dict[str, str], int]:
    """Read what lies past ``marks``, store the events that are not stored yet by day, and return the new marks and their number.

    Stored ids are compared only within the days that the new events touch. A run that fails before it returns
    leaves the marks as they were; the next one finds the stored events and adds the rest.
    """
    from flowrisk.operators import normalize
    from flowrisk.session import materialize

    marks = dict(marks or {})
    reached = marks | latest_files(spark, path, prefixes, pattern)  # files that arrive later are left for the next run
    entries = scan_logs(spark, path, prefixes, marks=marks, pattern=pattern)
    for source, last in reached.items():
        entries = entries.where(~F.col("source_file").contains(source) | (F.col("source_file") <= last))
    parsed = normalize.parse_entries(entries).where("log_format = 'audit'")
    found = normalize.canonicalize_audit(parsed).withColumn("day", F.to_date("ts"))
    fresh = normalize.dedup_events(found, ["ts"])
    target = spark._jvm.org.apache.hadoop.fs.Path(events_path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        stored = spark.read.parquet(events_path).select("event_id", "day")
        fresh = fresh.join(stored, ["event_id", "day"], "left_anti")
    fresh = materialize(fresh, "ingest")
    fresh.write.mode("append").partitionBy("day").parquet(events_path)
    return reached, fresh.count()


def stream_logs(spark: SparkSession, path: str, max_files: int = 1000, prefixes: list[str] | None = None) -> DataFrame:
    """The same scan as a stream; its checkpoint remembers which files are done."""
    raw = (spark.readStream.option("recursiveFileLookup", "true")
           .option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", max_files)
           .text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("value")))
    return split_entries(select_prefixes(raw, prefixes))


def select_prefixes(files: DataFrame, prefixes: list[str] | None) -> DataFrame:
    """Keep files whose path holds one of the log prefixes."""
    if not prefixes:
        return files
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.col("source_file").contains("/" + prefix)
    return files.where(hit)


def split_entries(raw: DataFrame, text: str = "value") -> DataFrame:
    """One row per JSON object; anything that is not an object is dropped.

    An array that cannot be read is kept as it is, so that it can be counted
    among the malformed entries.
    """
    line = F.regexp_replace(F.trim(F.col(text)), r",\s*$", "")
    several = F.coalesce(F.filter(F.from_json(line, "array<string>"), lambda e: F.trim(e).startswith("{")),
                         F.array(line))
    one_per_line = F.when(line.startswith("[") & line.endswith("]"), several) \
        .when(line.startswith("{") & line.contains("\n"), F.split(line, r"\n")) \
        .otherwise(F.array(F.regexp_replace(line, r"^\[\s*(?=\{)|(?<=\})\s*\]$", "")))
    keep = [c for c in raw.columns if c != text]
    return (raw.select(*keep, F.explode(one_per_line).alias("entry"))
            .withColumn("entry", F.trim("entry"))
            .where(F.col("entry").startswith("{") |
                   (F.col("entry").startswith("[") & F.col("entry").endswith("]"))))


def source_of(path, prefixes: list[str] = C.LOG_PREFIXES):
    """The first prefix that occurs in a path."""
    out = None
    for prefix in prefixes:
        hit = path.contains(prefix)
        out = F.when(hit, prefix) if out is None else out.when(hit, prefix)
    return out


def new_files(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Files (source, path) past the high-water mark of their source."""
    return (files.join(checkpoints.select("source", "last_path"), "source", "left")
            .where(F.col("last_path").isNull() | (F.col("path") > F.col("last_path")))
            .drop("last_path"))


def advance_checkpoints(checkpoints: DataFrame, done: DataFrame) -> DataFrame:
    """High-water marks after reading ``done``."""
    both = checkpoints.select("source", "last_path").unionByName(
        done.select("source", F.col("path").alias("last_path")))
    return both.groupBy("source").agg(F.max("last_path").alias("last_path"))
