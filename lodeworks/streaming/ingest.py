"""Incremental ingestion with Structured Streaming: new rows by key, counts by time, append-safe sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import canonical_url


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Parquet files as they come."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def new_urls(stream: DataFrame, url: str, time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose canonical url was not seen within the watermark; state is bounded by it."""
    return stream.withColumn("canonical", canonical_url(F.col(url))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["canonical"])


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Counts and sums (in hundredths) by window and type; the same for a stream and for a table."""
    own = events.withWatermark(time, delay) if events.isStreaming else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return own.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str, once: bool = True) -> StreamingQuery:
    """Appends rows whose key the table at `path` doesn't have yet, batch by batch; a batch that is run anew adds
    nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(path).select(key)
        except Exception as e:  # the table is not there before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            seen = batch.select(key).where("false")
        batch.dropDuplicates([key]).join(seen, key, "left_anti").write.mode("append").parquet(path)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
