"""Session and shared-storage helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "contestlake") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and stream state.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder, because there the driver's disk is the
    only disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="contestlake-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def run_dir(spark: SparkSession, label: str) -> str:
    """A new sub-folder of the shared folder for one run."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints of plans that are gone.

    It waits for the garbage collector of the driver, which rests while tasks
    work, so the files of all steps would lie on the disks at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Rows written to the shared folder and read back.

    A checkpoint keeps the size that the planner guessed, and in a loop of
    joins each guess multiplies the last, until the planner is busy with the
    digits.  A file has the size it has.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STEPS: ContextVar[dict | None] = ContextVar("steps", default=None)


@contextmanager
def shared_steps():
    """Inside, a step that several parts of one report ask for is written once; a report inside another shares its steps."""
    token = _STEPS.set({}) if _STEPS.get() is None else None
    try:
        yield
    finally:
        if token is not None:
            _STEPS.reset(token)


def sharing(report: Callable) -> Callable:
    """A query made of other queries, whose common steps are worked out once."""

    @wraps(report)
    def run(*args):
        with shared_steps():
            return report(*args)

    return run


def step(spark: SparkSession, sf: str, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make``: as a plan, or inside ``shared_steps`` as files written at the first call."""
    steps = _STEPS.get()
    if steps is None:
        return make()
    if (sf, label) not in steps:
        steps[sf, label] = stored(make(), label)
    return steps[sf, label]


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly to all tasks: few and small, but each one is much work, which sizes in bytes do not tell."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys)
