"""Session set-up, table access and the shared folder for cut lineages."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "skein", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine relies on: UTC, adaptive plans and Arrow transfer."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data folder; a file or a folder of files."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset (tests), a local one is set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if known:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(known)
        return known
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="skein-")
    sc.setCheckpointDir(own)
    return own


_written: list[tuple[SparkSession, str]] = []


def clean_up() -> None:
    """Deletes what :func:`cut` wrote in this process; called at its end, too."""
    while _written:
        spark, path = _written.pop()
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
        except Exception:  # the session is gone: what is on this machine can still be deleted
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


atexit.register(clean_up)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """The same rows behind a cut lineage: written once to the shared folder and read back, so that lost executors
    cost no recomputation and several readers share one computation. It is deleted when the process ends."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"skein-{name}-{uuid.uuid4().hex}")
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def session_name(project: str, day: str, override: str | None = None) -> str:
    """The name of a session: the one given, else the project folder's, in lower case with hyphens, and the day."""
    if override and override.strip():
        return override.strip()
    return f"{os.path.basename(os.path.normpath(project)).lower().replace(' ', '-')}-{day}"
