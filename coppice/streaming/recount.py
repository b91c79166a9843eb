"""Token and line counts kept up to date from a stream of inventories.

Each micro-batch is an inventory of changed files; only bodies whose key is new
are counted.  A batch writes to a folder named by its stream (a checkpoint's
own id) and its number, and looks up earlier counts in all the others: tried
again, it does the same once more, and another stream finds its rows there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from coppice.schema import ENTRY, FILES
from coppice.sources.trees import COUNT_KEY, recount

STORE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ENTRY]
    + [
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("method", T.StringType()),
        T.StructField("read_limit", T.LongType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("lines", T.LongType()),
    ]
)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """All counts; ``stream`` and ``batch`` say where they come from."""
    found = T.StructType([*STORE.fields, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(found).parquet(folder)


def keep_counted(
    inventories: str, bodies: str, store: str, checkpoint: str, spark: SparkSession
) -> StreamingQuery:
    """Count what the inventory files under ``inventories`` bring and stop."""
    spark.createDataFrame([], STORE).write.mode("append").parquet(f"{store}/stream=none/batch=-1")
    arriving = spark.readStream.schema(FILES).parquet(inventories)

    def count(batch: DataFrame, batch_id: int) -> None:
        stream = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        own = (F.col("stream") == stream) & (F.col("batch") == batch_id)
        prior = stored(spark, store).where(~own).drop("stream", "batch")
        contents = spark.read.schema("repo string, snapshot string, path string, text string").parquet(bodies)
        result = recount(batch, contents, prior)
        key = [F.col(f"n.{c}").eqNullSafe(F.col(f"p.{c}")) for c in COUNT_KEY]
        fresh = result.alias("n").join(prior.alias("p"), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{store}/stream={stream}/batch={batch_id}")

    return (
        arriving.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
