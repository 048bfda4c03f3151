"""Session helpers: scratch tables in the shared checkpoint folder, and shipping the package to executors."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the cluster's own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("galleria")
    base = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors where the Python path does not already give it."""
    root = str(PACKAGE.parent)
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in paths or os.getcwd() == root or getattr(sc, "_galleria_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="galleria-"), "galleria.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(out)
    sc._galleria_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session, in one process, gets a private one where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="galleria-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Spark's own switch to remove an execution's shuffle files when it has ended; here, when its table is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written once to the shared folder, so that lost executors need not repeat what made them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/galleria-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str) -> str:
        self.n += 1
        path = f"{self.base}/{self.n:02d}-{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        try:
            if before is not None:
                self.spark.conf.set(_CLEANUP, "true")
            df.write.mode("overwrite").parquet(path)
        finally:
            if before is not None:
                self.spark.conf.set(_CLEANUP, before)
        return path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        path = self.write(df, name)
        out = self.spark.read.schema(schema).parquet(path)
        out._galleria_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this scratch folder that nothing reads any more."""
        for t in tables:
            with contextlib.suppress(AttributeError):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(t._galleria_path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
