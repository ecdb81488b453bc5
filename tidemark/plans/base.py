"""How the driver's tables stand for the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def request_number():
    """Fifteen users stand for an episode and three of them for each of its five requests, so that requests and episodes grow with the table."""
    return (F.floor(F.col("user_id") / 15) * 5 + F.col("user_id") % 5).cast("int")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("r"), request_number()).alias("request_id"), F.concat(F.lit("repeat_"), F.col("event_id") % 2 + 1).alias("repeat_id"), F.col("event_type").alias("concept_id"),
        F.to_date("ts").alias("date"), F.least(F.lit(100.0), F.col("value") / 5).alias("interest"), (F.col("event_id") % 97 == 0).alias("is_partial"), "event_id", "user_id",
    )


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan row for each request that has observations: of an episode the treated one, the national one and three controls, each a day later than the one before."""
    e = table(spark, sf_dir, "events").select(request_number().alias("n")).distinct().withColumn("i", F.col("n") % 5)
    role = F.when(F.col("i") == 0, "treated").when(F.col("i") == 1, "national").otherwise("control")
    onset = F.date_add(F.lit("2024-01-15").cast("date"), F.col("i"))
    episode = F.concat(F.lit("ep"), F.floor(F.col("n") / 5).cast("string"))
    return e.select(F.concat(F.lit("r"), F.col("n")).alias("request_id"), onset.alias("onset"), F.date_add(onset, 1).alias("event_end"), role.alias("role"), episode.alias("episode_id"), F.concat(F.lit("US-"), F.col("i")).alias("geography"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily(observations(spark, sf_dir), "event_id")


SQL = """
obs AS (SELECT 'r' || (user_id // 15 * 5 + user_id % 5) AS request_id, 'repeat_' || (event_id % 2 + 1) AS repeat_id, event_type AS concept_id, CAST(ts AS DATE) AS date,
  least(100.0, value / 5) AS interest, event_id % 97 = 0 AS is_partial, event_id, user_id FROM events),
plan AS (SELECT 'r' || n AS request_id, DATE '2024-01-15' + CAST(n % 5 AS INT) AS onset, DATE '2024-01-16' + CAST(n % 5 AS INT) AS event_end,
  CASE n % 5 WHEN 0 THEN 'treated' WHEN 1 THEN 'national' ELSE 'control' END AS role, 'ep' || (n // 5) AS episode_id, 'US-' || (n % 5) AS geography FROM (SELECT DISTINCT user_id // 15 * 5 + user_id % 5 AS n FROM events)),
daily AS (SELECT request_id, repeat_id, concept_id, date, avg(interest) AS value FROM obs WHERE interest IS NOT NULL AND NOT is_partial GROUP BY ALL)
"""
