"""Session and configuration."""

from __future__ import annotations

import json
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Model, dimension, thresholds and result sizes; `from_json` reads the keys it knows and ignores others."""

    model: str = "hashed"
    dimensions: int = 64
    batch_size: int = 10
    similarity_threshold: float = 0.3
    top_k: int = 5
    shuffle_partitions: int = 8

    @classmethod
    def from_json(cls, path: str) -> EngineConfig:
        with open(path) as f:
            found = json.load(f)
        return cls(**{x.name: found[x.name] for x in fields(cls) if x.name in found})


def session(config: EngineConfig | None = None, master: str | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; skewed joins are split and small partitions joined at run time."""
    config = config or EngineConfig()
    builder = SparkSession.builder.appName("vectrine")
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", config.shuffle_partitions)
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of all executors, for clusters on which it is not installed."""
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="vectrine-")) / "vectrine.zip"  # Spark's own file server hands it out
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for x in sorted(root.rglob("*.py")):
            z.write(x, x.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))


#: A table with fewer bytes than this for each core may lie in one row group, which one task reads.
SMALL_BYTES_A_CORE = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it is so small that few tasks would read it; df itself otherwise.

    For steps that work long on each row. The size is Spark's own estimate, so a large table is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES_A_CORE * cores and len(df.inputFiles()) < cores else df


_SCOPE: ContextVar[str | None] = ContextVar("vectrine_scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: spark.checkpoint.dir.

    Where it is unset, a local session (one process) gets a temporary folder of its own; a cluster has no folder that
    could be guessed, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and at.isDefined():
        found = at.get()
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vectrine-")
    if not at.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, inside the running `scratch` scope where there is one."""
    return f"{_SCOPE.get() or shared_dir(spark) + '/vectrine'}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A run scope: the tables that operators write inside it are deleted at its end.

    Write or collect results before the scope ends, since they may read those tables.
    """
    path = work_path(spark, "run")
    before = _SCOPE.set(path)
    try:
        yield path
    finally:
        _SCOPE.reset(before)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back with its own schema.

    Unlike a cache or a local checkpoint, the rows outlive every executor. files bounds the number of files, and of
    tasks that make them, where the caller knows how many rows to expect; small tables then are few files.
    """
    path = work_path(df.sparkSession, tag)
    (df.coalesce(max(1, files)) if files is not None else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
