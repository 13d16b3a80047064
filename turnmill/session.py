"""Session settings and the shared folder that staged tables are written to."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}
_MADE: list[str] = []


def build_session(app: str = "turnmill", master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with the settings this library expects; cluster values win where they are set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's ``spark.checkpoint.dir``.

    Where the session names none, a single-machine session (master ``local`` or ``local[..]``, whose tasks run in the
    driver's process) gets one temporary folder per application; any other session is refused, because a machine-local
    folder would not be seen by its executors.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="turnmill-")
    return _LOCAL[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; the innermost ``staging`` block owns it."""
    path = f"{shared_dir(spark)}/turnmill/{label}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Removes the folders that are made inside, when the block ends.

    What is to outlive the block must have been written to a folder named before it.  Tables staged outside any block
    stay until their folder is dropped.
    """
    mark = len(_MADE)
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for path in _MADE[mark:]:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        del _MADE[mark:]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This is the encoded-corpus boundary: planning then reads the narrow length column only, and
    the token arrays are read once more when the plan is known.  Lineage ends here, so a lost
    executor costs a re-read, not a re-encode.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A table is sent to every executor only when it is counted to have at most so many rows.
BROADCAST_ROWS = 1 << 20


def if_small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """``table`` (staged), marked for broadcast if its counted rows allow that; otherwise the join is shuffled."""
    return F.broadcast(table) if table.count() <= (BROADCAST_ROWS if rows is None else rows) else table


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a scan with fewer partitions than the session has cores, dealt out over all cores.

    A table of few row groups would run text work in as few tasks.  A table of many is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
