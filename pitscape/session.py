"""Session and lineage helpers."""

from __future__ import annotations

import contextlib
import gc
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_own_folder: str | None = None


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pitscape")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for working tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a temporary folder of its own; on
    a cluster its absence is an error, since executors do not share local disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own_folder
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="pitscape-ck-")
    return _own_folder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that functions of it run there from any folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="pitscape-zip-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


#: Called with every frame and its checkpoint, while somebody asks where columns come from.
_cut_listeners: list = []


@contextlib.contextmanager
def _passing_shuffles(spark: SparkSession):
    """Plans made inside drop their shuffle files as soon as they have run, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    with _passing_shuffles(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)  # a plan of its own: that of ``df`` may be used again
    for listener in _cut_listeners:
        listener(df, out)
    return out


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as compressed Parquet: for tables of many rows that repeat their values.

    Its columns stay prunable and the planner knows its size. The files stay in the shared folder.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    with _passing_shuffles(spark):
        df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    for listener in _cut_listeners:
        listener(df, out)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and checkpoints of steps that are over; it only hears of them when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
