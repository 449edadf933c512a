"""Where intermediate tables go, and how they go away again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Without that setting, a session whose tasks run in the driver (tests, a laptop) gets a folder of
    its own. On a cluster a machine's own folder would lose what the other machines write to
    theirs, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='clauseflow-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more; a missing one is no fault."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
