"""Cutting lineage through tables in the shared folder of the cluster.

Iterative operators (graph rounds, model fits over all rows) need a point from which a lost executor's work can be
read again.  Such tables go to the folder named by ``spark.checkpoint.dir``, which every executor and the driver share;
nothing is ever written to a machine's own temporary folder unless the setting is absent and driver and executors are one
process, as in tests.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's ``spark.checkpoint.dir``, or a folder of our own where unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        if app not in _fallback:
            own = tempfile.mkdtemp(prefix="manyfold-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _fallback[app] = f"file://{own}"
        base = _fallback[app]
    return f"{base.rstrip('/')}/manyfold-{app}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    The result has no lineage beyond the files, so later stages that lose an executor re-read instead of recompute.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table this application has materialised; call it when no DataFrame built on them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
