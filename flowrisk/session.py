"""Session settings and durable lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

# Settings the library relies on. All are runtime settings, so they can be
# applied to a session somebody else made.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lookups against a unique key stay correct under skew because AQE splits
    # the crowded side and repeats the small one.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sides whose shuffled parts are all this small are hashed, not sorted by their text keys.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed state with timers needs it; state larger than memory stays on disk.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library relies on."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "flowrisk") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can read.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where
    that is unset (tests on one machine) a folder is made here.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to shared storage so that iterations survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# Where the frames that materialize() returned are stored.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table as the program ends; the session may have ended before."""
    context = spark.sparkContext
    if context._jsc is not None:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    For tables that several later steps read. Unlike a cache it survives lost
    executors, and unlike a checkpoint it is columnar, so readers prune columns
    and the optimizer knows its size.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each write as it ends, instead of when the driver happens to collect its garbage.

    For series of large exchanges, each of which is written and read again; nothing else may use the session meanwhile.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize``, with aggregates over all rows, which are taken from the written columns they need.

    Not by an Observation: a session that has had one can no longer apply fitted ML models (they hold on to the session, which then cannot be serialised).
    """
    out = materialize(df, name)
    return out, out.agg(*[c.alias(k) for k, c in metrics.items()]).first().asDict()


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables that nothing reads any more, instead of at the end of the program.

    For the frames that ``materialize`` returned, once all that is derived from them is written.
    """
    for table in tables:
        if (path := _PATHS.pop(table, None)) is not None:
            _remove(table.sparkSession, path)


def materialize_by(df: DataFrame, name: str, key: str, **options: str) -> DataFrame:
    """``materialize`` in buckets of a key, as many as a shuffle has partitions, so that grouping by it shuffles the table no more.

    The name in the session's catalog is a temporary one; the files lie with the other intermediate tables.
    """
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    atexit.register(_remove, spark, path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.options(path=path, **options).bucketBy(n, key).saveAsTable(table, format="parquet")
    return spark.read.table(table)


def materialize_all(frames: dict[str, DataFrame]) -> list[DataFrame]:
    """Materialize independent tables at the same time, so that small ones fill idle executors."""
    shared_folder(next(iter(frames.values())).sparkSession)
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(lambda item: materialize(item[1], item[0]), frames.items()))
