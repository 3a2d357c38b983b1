"""Shared-folder helpers: where a plan is cut, the rows go to storage that every executor can read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one set for checkpoints. A temporary one, removed at exit, serves only one machine; a cluster without a shared folder is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        given = held.get() if held.isDefined() else None
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="strandweave-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return _LOCAL["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Used where several consumers need the same costly rows, or where values must not change when a lost
    executor's tasks run again. The files are ordinary reliable storage, so later stages survive lost executors.
    They stay as long as results may read them; ``scratch`` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside is removed at the end; write or collect results inside."""
    mark = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[mark:]:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        del _WRITTEN[mark:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
