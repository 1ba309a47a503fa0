"""Session settings and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Folders that this driver has made below the shared one.
_made: list[str] = []
# Spark removes the shuffle files of a query when it ends, not when the driver collects garbage.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Applications whose workers have the package.
_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Set the one runtime option the JSON reader relies on."""
    # A repeated JSON key keeps its last value instead of failing the record.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session's application, once.

    Operators that run in Python workers need it there. Call it after the session is made,
    unless the package is installed on every node or passed with ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="turnmill-package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster
    session without it is an error, since a machine-local folder would be
    invisible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    named = tempfile.mkdtemp(prefix="turnmill-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet. What is written there is
    dropped with the intermediate tables."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, keeps column pruning, and gives the optimizer the real size. The shuffle
    files of the write go as soon as it is done, since no later query reads them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> int:
    """Delete what was written to folders of :func:`new_folder` so far, the tables of
    :func:`materialize` among them; how many folders.

    Call it when results are written: frames that still read those tables fail.
    """
    hadoop = spark._jsc.hadoopConfiguration()
    count = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return count
