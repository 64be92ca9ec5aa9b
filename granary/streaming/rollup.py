"""Daily rollup of events, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import amount_sum
from granary.plans.registry import register, table


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), amount_sum(F.col("value")).alias("total"))


def daily_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream's daily totals; a day is closed once events ``late`` past its end have come."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = stamped.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), amount_sum(F.col("value")).alias("total"))
    return sums.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


register("daily_rollup", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(CAST(round(value, 4) AS DECIMAL(18, 4))) AS total FROM events GROUP BY ALL")(lambda spark, folder: daily(table(spark, folder, "events")))
