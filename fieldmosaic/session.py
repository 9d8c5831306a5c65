"""Session defaults, shared scratch space and the checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODEC = "spark.sql.parquet.compression.codec"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "fieldmosaic", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the wide sample tables need; all may change at run time.

    They stay set for the session: call this once, where the session is made. Registered
    queries call it because they are handed sessions of others.

    Generated methods above 8000 bytes are never compiled by the JVM's JIT. With
    120 bands the fused loops pass that mark and would run interpreted, about ten
    times slower; at this limit Spark falls back to split-up generated code.

    Parquet is written with zstd where no codec was chosen: bands as doubles fill an eighth
    less disk than with snappy.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    if spark.conf.get(CODEC, None) is None:
        spark.conf.set(CODEC, "zstd")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may leave it unset; it then gets one temporary folder
    per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="fieldmosaic-")
        context.setCheckpointDir(_local_scratch[app])
    return _local_scratch[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of a query that runs inside are deleted when it ends, not when the
    driver's garbage is collected."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000, max_bytes: int = 8 << 20) -> DataFrame:
    """Mark a side for broadcast only after its rows were counted and measured to be few.

    At most ``max_rows + 1`` rows are fetched, by a job that runs while the plan is built.
    When they all fit, in number and bytes, the fetched rows replace the plan, so the side
    is computed once and its size is known.
    Otherwise ``df`` is returned as it was and the join shuffles, with hot keys
    split by adaptive execution.
    """
    spark = df.sparkSession
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows or head.nbytes > max_bytes:
        return df
    return F.broadcast(spark.createDataFrame(pa.table(head), schema=df.schema))
