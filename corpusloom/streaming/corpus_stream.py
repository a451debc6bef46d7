"""The corpus as a stream, and cache state over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import vote


def read(spark: SparkSession, sf_dir: str, name: str = "documents", files_per_trigger: int = 16) -> DataFrame:
    """A Parquet table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(held).isFile():
        # a stream reads folders: the one file of its folder that has this name
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.option("pathGlobFilter", "*.parquet").parquet(path)


def vote_stream(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The ensemble vote of all that is there, written as Parquet exactly once and read back."""
    voted = vote.summary(vote.sentences(stream))
    query = voted.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return stream.sparkSession.read.parquet(path)


def ttl_cache(accesses: DataFrame, key: str, ts: str, ttl: str = "7 days") -> DataFrame:
    """(key, since, until, accesses): spans in which a key with this time to live stays cached; late rows within the watermark count."""
    watermarked = accesses.withWatermark(ts, ttl)
    spans = watermarked.groupBy(F.session_window(ts, ttl).alias("w"), key).agg(F.count(F.lit(1)).alias("accesses"))
    return spans.select(key, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "accesses")
