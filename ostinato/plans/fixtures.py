"""The driver's tables in the roles of the sequence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions import tokens as T
from ostinato.functions.qualities import lookup
from ostinato.operators.sequences import ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chords of songs: song, pos (from 0), t (microseconds), q (class), root (0..11), w (weight)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("song"),
        (F.row_number().over(ordered(["user_id"], ["ts", "event_id"])) - 1).cast("long").alias("pos"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("event_type").alias("q"),
        F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(12)).alias("root"),
        F.col("value").alias("w"),
    )


#: Quality tails of the events' types.
TAILS = {"click": "^7", "error": "h7", "purchase": "7", "signup": "-7", "view": ""}


def chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a chord ``token`` of their root and type; every fifth weight adds a slash bass, the fifth."""
    e = events(spark, sf_dir)
    name = lambda names, pc: F.element_at(F.array(*map(F.lit, names)), (F.pmod(pc, F.lit(12)) + 1).cast("int"))
    bass = F.when(F.floor("w") % 5 == 0, F.concat(F.lit("/"), name(T.SHARPS, F.col("root") + 7))).otherwise("")
    return e.withColumn("token", F.concat(name(T.FLATS, F.col("root")), lookup(TAILS, F.col("q")), bass))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as long sequences with runs: song, t, id, status, price."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("song"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")
    )


#: The same tables as SQL; queries begin with these.
EVENTS_SQL = """
WITH ev AS (
  SELECT user_id AS song, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, epoch_us(ts) AS t,
         event_type AS q, CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 AS root, value AS w
  FROM events)
"""
ORDERS_SQL = """
WITH ord AS (
  SELECT o_custkey AS song, epoch_us(o_orderdate) AS t, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders)
"""
CHORDS_SQL = (
    EVENTS_SQL
    + """, ch AS (SELECT *, CASE q WHEN 'click' THEN '^7' WHEN 'error' THEN 'h7' WHEN 'purchase' THEN '7' WHEN 'signup' THEN '-7' ELSE '' END AS tail,
    CASE q WHEN 'click' THEN 'maj' WHEN 'error' THEN 'm7b5' WHEN 'purchase' THEN 'dom' WHEN 'signup' THEN 'min' ELSE 'maj' END AS class,
    CASE WHEN CAST(floor(w) AS BIGINT) % 5 = 0 THEN (root + 7) % 12 END AS bass,
    CASE q WHEN 'click' THEN [0, 4, 7, 11] WHEN 'error' THEN [0, 3, 6, 10] WHEN 'purchase' THEN [0, 4, 7, 10] WHEN 'signup' THEN [0, 3, 7, 10] ELSE [0, 4, 7] END AS tones,
    CASE WHEN q IN ('click', 'error', 'purchase', 'signup') THEN [2.0::DOUBLE, 1.5, 1.0, 0.8] ELSE [2.0::DOUBLE, 1.5, 1.0] END AS weights,
    ['C', 'Db', 'D', 'Eb', 'E', 'F', 'Gb', 'G', 'Ab', 'A', 'Bb', 'B'] AS flats, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'] AS sharps FROM ev),
    tone AS (SELECT song, pos, root, (root + x) % 12 AS pc, y FROM (SELECT song, pos, root, unnest(tones) AS x, unnest(weights) AS y FROM ch)
      UNION ALL SELECT song, pos, root, bass, 1.0 FROM ch WHERE bass IS NOT NULL),
    mk AS (SELECT song, pos, CAST(sum(DISTINCT 1 << pc) AS INTEGER) AS mask FROM (SELECT song, pos, (root + unnest(tones)) % 12 AS pc FROM ch) GROUP BY 1, 2)
"""
)
