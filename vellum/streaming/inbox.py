"""A stream of clipped pages: the batch transformations over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import urls
from ..operators import html_blocks


def clips(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """New rows of a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_clips(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """The first clip of every page; state is kept for ``delay`` after a page was last new.

    Pages are compared by host and path, so tracking queries and schemes make no second page.
    """
    keyed = stream.withColumn("page", F.coalesce(urls.page_key(F.col("url")), F.col("url")))
    return keyed.withWatermark("clipped_at", delay).dropDuplicatesWithinWatermark(["page"])


def clips_per_day(stream: DataFrame, delay: str = "60 days") -> DataFrame:
    """Clips by day and domain, final once the watermark has passed the day."""
    day = F.window("clipped_at", "1 day")
    name = urls.domain(F.col("url"))
    return stream.withWatermark("clipped_at", delay).groupBy(day.alias("w"), name.alias("domain")).agg(F.count(F.lit(1)).alias("n_clips")).select(
        F.col("w.start").alias("day"), "domain", "n_clips"
    )


def to_blocks(stream: DataFrame, target: str, checkpoint: str):
    """Write the blocks of every new clip to ``target``; each micro-batch goes through the batch operator."""

    def write(batch: DataFrame, number: int) -> None:
        html_blocks.blocks(batch).withColumn("batch", F.lit(number)).write.mode("append").partitionBy("batch").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
