"""Session settings the operators rely on, and the shared folder for cut lineage and stream state."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Runtime settings.  AQE picks join strategies and partition counts from measured sizes, so the
# operators carry no broadcast hints and no hard-wired partition counts.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # shares are merged up to this size as compressed; the same rows can take fifty times as much where they are sorted
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.parquet.filterPushdown": "true",
    # up to so many folders are listed by the driver itself, without a job for it
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "512",
}

# Settings a session takes only when it is created.  Without the first, PySpark inspects the Python stack
# for every column expression, which doubles the time wide plans take to build.
STATIC_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "telemill", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Create a session.  ``master`` stays unset on a cluster, where spark-submit supplies it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for ``purpose`` below the cluster's shared checkpoint folder.

    A cluster names that folder in ``spark.checkpoint.dir``.  Where it is unset, a temporary folder serves a
    local master, whose driver and executors are one process; any other raises RuntimeError, as its executors
    would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="telemill-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def config_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A few rows of configuration as a relation whose size Spark knows, read without a Python task."""
    names = schema.fieldNames()
    return spark.createDataFrame(
        pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=to_arrow_schema(schema)), schema
    )
