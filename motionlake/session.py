"""Session helpers: local test sessions, inline dimension tables, durable cut points."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SETTLED: list[str] = []


def local_session(cores: str = "*", app: str = "motionlake") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one the session names in ``spark.checkpoint.dir``. Only a local[*] session
    without that setting gets a temporary folder; on a cluster a missing setting is an
    error, because a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="motionlake-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    This cuts the lineage like a checkpoint, computes ``df`` once, survives the loss of
    executors, and leaves a table with column pruning and sizes for adaptive planning.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SETTLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_settled(spark: SparkSession) -> int:
    """Delete the tables that ``settle`` wrote in this process; returns how many."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _SETTLED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SETTLED.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application.

    Spark hands the archive from the driver to every executor, so Arrow kernels import
    wherever they run and however the session was started.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="motionlake-package-"), "motionlake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("motionlake", os.path.relpath(path, root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (tuple, list)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed, small dimension as a local relation (known size, foldable, no job)."""
    columns = [part.strip().split(" ", 1) for part in schema.split(", ")]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in columns)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS dim({names})")
