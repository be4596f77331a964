"""Session helpers: configuration, table access and materialisation in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine relies on; cluster sizing (partitions, memory) is left to the session.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the engine's settings, for tests, benchmarks and the command line."""
    builder = SparkSession.builder.master(master).appName("tabbyline")
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test or production table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by `spark.checkpoint.dir`.

    A folder of our own is used only where the setting is absent, which is right on a single
    machine (tests, benchmarks); on a cluster without the setting this raises.
    """
    conf = spark.sparkContext.getConf()
    configured = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own_dir
    if _own_dir is None:
        import shutil

        _own_dir = tempfile.mkdtemp(prefix="tabbyline-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


_own_dir: str | None = None


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage, survives the loss of
    executors, and is pruned by column on every later read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabbyline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialise` writes within are deleted at the end, when what is derived from them has been written."""
    before = len(_written)
    try:
        yield
    finally:
        release(spark, before)


def release(spark: SparkSession, kept: int = 0) -> int:
    """Delete the tables that `materialise` has written in this process, but for the first `kept`; how many there were.

    To be called when results that were derived from them have been written: until then they are read."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    count = len(_written) - kept
    while len(_written) > kept:
        at = jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(hadoop).delete(at, True)
    return count


def ensure_shipped(spark: SparkSession) -> None:
    """Make this package importable in Python workers of a cluster whose PYTHONPATH lacks it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    on_path = any(os.path.abspath(p) == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)
    if on_path or getattr(sc, "_tabbyline_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tabbyline-pkg-"), "tabbyline_pkg.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(os.path.dirname(os.path.abspath(__file__))):
            for name in files:
                if name.endswith((".py", ".json")):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    sc._tabbyline_shipped = True
