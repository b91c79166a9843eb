"""Session settings and the lineage cut used by the iterative operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Whole file bodies travel in these batches: keep them short and bounded in bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}


def build(master: str | None = None, app: str = "coppice", **extra: str) -> SparkSession:
    """A session with the settings above.  ``master`` is for local runs only."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    A cluster has to name it in ``spark.checkpoint.dir``.  Only a local master,
    where driver and tasks share one machine, gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    named = tempfile.mkdtemp(prefix="coppice-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


class Rounds:
    """Written rounds of a loop.

    Each round goes to its own Parquet folder in the shared folder and is read
    back, so the plan does not grow, a lost executor costs at most the current
    round, and everything found so far is one scan over all the folders.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._written: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        """Write one more round and return it as read back."""
        folder = f"{self._base}/round={len(self._written)}"
        df.write.parquet(folder)
        self._written.append(folder)
        return self._spark.read.schema(df.schema).parquet(folder)

    def all(self, like: DataFrame) -> DataFrame:
        """All the rounds as one frame."""
        return self._spark.read.schema(like.schema).parquet(*self._written)


class Newest:
    """The newest of a loop's written rounds.

    The one before it is deleted as soon as the next one stands, so a loop of
    any length takes the room of two rounds.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._round = 0

    def set(self, df: DataFrame) -> DataFrame:
        """Write the next round and return it as read back."""
        folder = f"{self._base}/round={self._round}"
        df.write.parquet(folder)
        if self._round:
            before = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._base}/round={self._round - 1}")
            before.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(before, True)
        self._round += 1
        return self._spark.read.schema(df.schema).parquet(folder)


class Folder:
    """A folder of its own in the shared folder, for loops that write several tables."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self._base}/{table}"

    def drop(self, pattern: str) -> None:
        """Delete the tables whose names match."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.path(pattern))
        system = path.getFileSystem(self._spark._jsc.hadoopConfiguration())
        for found in system.globStatus(path) or []:
            system.delete(found.getPath(), True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back."""
    return Rounds(df.sparkSession, name).add(df)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


@contextlib.contextmanager
def _held(spark: SparkSession, key: str, value: str):
    """A setting for what is run inside, put back afterwards."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def loop_settings(spark: SparkSession):
    """Settings for self-joining loops, put back afterwards."""
    return _held(spark, "spark.sql.constraintPropagation.enabled", "false")


def short_batches(spark: SparkSession, rows: int):
    """At most so many rows in an Arrow batch for what is written inside.

    A batch is held several times over, by the JVM outside its heap and by Python,
    for each running task; with whole texts in it Spark's 10,000 rows are too many.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    at_most = int(spark.conf.get(key))
    return _held(spark, key, str(min(rows, at_most) if at_most > 0 else rows))


@contextlib.contextmanager
def short_tasks(spark: SparkSession, part: str = "4m"):
    """Tasks of little input for what is written inside.

    Rows that repeat their keys pack well, so a task of Spark's usual 64 MB
    shuffled or 128 MB read holds many times that where it sorts them.
    """
    with (
        _held(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", part),
        _held(spark, "spark.sql.files.maxPartitionBytes", part),
    ):
        yield
