"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local session may leave it unset (tests, single machine): such a session gets a
    temporary folder that goes with the process. A cluster session without it is an error,
    because a folder of one machine would lose rows there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.master.startswith("local-cluster") or not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        own = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[context.applicationId] = f"file://{own}"
    return _OWN[context.applicationId]


#: Folders that are in use by a caller of temporary().
_MADE: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Intermediate tables that are made inside are deleted on leaving, on success and on failure: write the results before."""
    before = len(_MADE)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in _MADE[before:]:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        del _MADE[before:]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, a lost executor costs nothing
    that was finished, and what follows never computes ``df`` twice."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = context.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root in known.split(os.pathsep):
        return
    context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if not context.master.startswith("local"):
        bundle = os.path.join(tempfile.mkdtemp(), "weft.zip")
        with zipfile.ZipFile(bundle, "w") as out:
            for folder, _, names in os.walk(os.path.join(root, "weft")):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, root))
        context.addPyFile(bundle)
