"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Steps are written to be read a few times in one job; this codec takes less disk than the default.
SCRATCH_CODEC = "zstd"
_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chainweft")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would not survive the loss of an executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return _local_dirs.setdefault(context.applicationId, tempfile.mkdtemp(prefix="chainweft-"))


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    Parquet keeps column pruning and file sizes for the stages that follow, so
    the next join is planned from the real size of the step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", SCRATCH_CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: Sequence[str], label: str = "step", once: bool = False,
             dealt: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``keys`` and read it back.

    Joins on exactly these keys read the buckets as they are and shuffle only
    their other side.  There are as many buckets as shuffle partitions, which
    Spark asks for to leave this side in place.  With ``once`` equal rows, which
    meet in their bucket, are written once.  ``dealt`` frames come from a
    ``repartition`` to that number by ``keys`` and are not shuffled again.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if dealt else df.repartition(count, *keys)
    rows = rows.distinct() if once else rows
    rows.write.bucketBy(count, *keys).sortBy(*keys).option("compression", SCRATCH_CODEC).option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)
