"""The driver's tables in the shape of the event model.

The oracle side writes the same view in SQL, see ``view_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldline.sources.readers import normalise_events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENT_TYPE = """
CASE WHEN k = 99 THEN 6L ELSE
  CASE event_type WHEN 'click' THEN 8L WHEN 'view' THEN 10L WHEN 'purchase' THEN 1L WHEN 'signup' THEN 2L ELSE 3L END
END AS eventId"""

RAW_EVENT = [
    "event_id AS id",
    "user_id AS playerId",
    "CAST(dayofmonth(ts) AS BIGINT) AS matchId",
    "CASE WHEN hour(ts) < 12 THEN '1H' ELSE '2H' END AS matchPeriod",
    "user_id % 2 AS teamId",
    "eventId",
    """CASE eventId WHEN 6 THEN 60L WHEN 8 THEN element_at(array(80L, 83L, 85L, 86L), k % 4 + 1) WHEN 10 THEN 100L
         WHEN 1 THEN IF(k % 2 = 0, 12L, 10L) WHEN 2 THEN 20L ELSE element_at(array(30L, 32L, 33L), k % 3 + 1)
       END AS subEventId""",
    "event_type AS eventName",
    "(hour(ts) % 12) * 3600 + minute(ts) * 60 + CAST(extract(SECOND FROM ts) AS DOUBLE) AS eventSec",
    """transform(array_compact(array(
         IF(k % 5 < 3, 1801L, NULL), IF(k % 11 = 0, 101L, NULL), IF(k % 13 = 0, 301L, NULL),
         IF(k % 17 = 0, 302L, NULL), IF(k % 19 = 0, 1401L, NULL), IF(k % 23 = 0, 1702L, NULL),
         IF(k % 2 = 0, 401L, 402L), IF(k % 3 = 0, 703L, NULL))), t -> named_struct('id', t)) AS tags""",
    """IF(event_id % 4 = 0,
         array(named_struct('y', y, 'x', x)),
         array(named_struct('y', y, 'x', x), named_struct('y', y_end, 'x', x_end))) AS positions""",
]


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = table(spark, sf_dir, "events").selectExpr("*", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    placed = numbered.selectExpr(
        "*",
        EVENT_TYPE,
        "CAST(IF(k = 98, 100, k) AS DOUBLE) AS x",
        "CAST(event_id * 7 % 101 AS DOUBLE) AS y",
        "CAST(IF(event_id % 50 = 1, IF(k = 98, 100, k), (k * 31 + event_id) % 101) AS DOUBLE) AS x_end",
        "CAST(IF(event_id % 50 = 1, event_id * 7 % 101, event_id * 13 % 101) AS DOUBLE) AS y_end",
    )
    return placed.selectExpr(*RAW_EVENT)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_events(raw_events(spark, sf_dir))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS wyId",
        "c_name AS shortName",
        "c_name AS lastName",
        "c_custkey % 2 AS currentTeamId",
        "CAST(c_custkey % 30 + 165 AS DOUBLE) AS height",
        "CAST(c_custkey % 35 + 60 AS DOUBLE) AS weight",
        """named_struct('code2', CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'DF' WHEN 'BUILDING' THEN 'MD'
             WHEN 'FURNITURE' THEN 'FW' WHEN 'MACHINERY' THEN 'GK' END, 'code3', CAST(NULL AS STRING)) AS role""",
    )


def player_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return players(spark, sf_dir).select(F.col("wyId").alias("playerId"), F.col("shortName").alias("name"))


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("bigint")
    return n.select(
        key.alias("wyId"),
        F.concat(F.lit("Team"), key.cast("string")).alias("name"),
        F.col("n_name").alias("officialName"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.dayofmonth("ts").cast("bigint").alias("wyId")).distinct()
    label = F.when(F.col("wyId") % 2 == 0, "Team0 - Team1").otherwise("Team1 - Team0")
    return days.withColumn("label", label)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("components"))
