"""Light curves and stars out of the driver's tables, as DataFrames and as the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import columns as C

#: The dip planted into the events.
PERIOD, DURATION, T0 = 3.7, 0.2, 1.5
#: A dip asked of every user's curve, as a share of the period.
SHARE = 0.054


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One curve per user: days since the first event plus one, value over the user's mean."""
    e = _table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("user_id").cast("string").alias("lc_id"), "value")
    first = e.agg(F.min("us").alias("first"))
    e = e.crossJoin(F.broadcast(first)).select("lc_id", "event_id", (1 + (F.col("us") - F.col("first")) / 86400e6).alias("t"), (F.col("value") / F.avg("value").over(Window.partitionBy("lc_id"))).alias("y"))
    return e.select("lc_id", (F.row_number().over(Window.partitionBy("lc_id").orderBy("t", "event_id")) - 1).cast("long").alias("idx"), "t", "y", F.lit(None).cast("double").alias("dy"))


def _numbered(e: DataFrame) -> DataFrame:
    """``e`` with __row, its place in order of t and event_id, counted inside each minute and moved by the rows of the minutes before it.

    Only one row per minute that holds points is sorted as a whole; ``e`` itself is dealt by minute.
    """
    e = e.withColumn("__minute", F.floor(F.col("t") * 1440))
    before = F.sum("__held").over(Window.orderBy("__minute").rowsBetween(Window.unboundedPreceding, -1))
    starts = e.groupBy("__minute").agg(F.count("*").alias("__held")).select("__minute", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__minute").orderBy("t", "event_id")) - 1
    return e.withColumn("__inside", inside).join(starts, "__minute").withColumn("__row", (F.col("__before") + F.col("__inside")).cast("long")).drop("__minute", "__inside", "__before")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one curve, nearly flat, with a dip of one per cent."""
    e = _table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    e = e.crossJoin(F.broadcast(e.agg(F.min("us").alias("first")))).select("event_id", "value", (1 + (F.col("us") - F.col("first")) / 86400e6).alias("t"))
    y = 1 - F.when(C.in_transit(F.col("t"), PERIOD, DURATION, T0), F.lit(0.01)).otherwise(F.lit(0.0)) + 1e-3 * (F.col("value") - 49) / 49
    return _numbered(e).select(F.lit("planted").alias("lc_id"), F.col("__row").alias("idx"), "t", y.alias("y"), F.lit(None).cast("double").alias("dy"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by day over their median: an even cadence.  Days are numbered in one task: there is a row per calendar day, whatever the sales."""
    d = _table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").cast("double").alias("s"))
    m, first = d.agg(F.median("s").alias("m"), F.min("day").alias("first")), "first"
    d = d.crossJoin(F.broadcast(m)).select((F.datediff("day", first) + 1).cast("double").alias("t"), (F.col("s") / F.col("m")).alias("y"))
    return d.select(F.lit("daily").alias("lc_id"), (F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("idx"), "t", "y", F.lit(None).cast("double").alias("dy"))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star per supplier, by arithmetic on its key."""
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(
        k.cast("long").alias("star_id"), (2500 + k * 37 % 7000).cast("double").alias("teff"), (2.5 + k * 13 % 25 / 10).cast("double").alias("logg"),
        (0.1 + k * 7 % 20 / 10).cast("double").alias("mass"), (0.2 + k * 11 % 30 / 10).cast("double").alias("radius"),
    )


def darkening(spark: SparkSession) -> DataFrame:
    """A limb-darkening table made by rule: temperatures by 250, gravities by 1/2, not all pairs."""
    r = spark.range(0, 320).withColumnRenamed("id", "i")
    teff, logg = 2300 + F.floor(F.col("i") / 10) * 250, 0.5 * (F.col("i") % 10)
    rows = r.filter("i % 7 <> 3").select(F.col("i").alias("ld_row"), teff.cast("double").alias("teff"), logg.cast("double").alias("logg"))
    return rows.select("*", (0.9 - F.col("teff") / 20000).alias("a"), (0.1 + F.col("logg") / 20).alias("b"))


EVENTS_SQL = """
e0 AS (SELECT CAST(user_id AS VARCHAR) AS lc_id, event_id, 1 + (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400e6 AS t,
  value / avg(value) OVER (PARTITION BY user_id) AS y FROM events),
lc AS (SELECT lc_id, row_number() OVER (PARTITION BY lc_id ORDER BY t, event_id) - 1 AS idx, t, y FROM e0)
"""

PLANTED_SQL = f"""
p0 AS (SELECT event_id, value, 1 + (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400e6 AS t FROM events),
p1 AS (SELECT event_id, value, t, t - {T0} + {PERIOD} / 2 AS x FROM p0),
lc AS (SELECT 'planted' AS lc_id, row_number() OVER (ORDER BY t, event_id) - 1 AS idx, t,
  1 - CASE WHEN abs(x - {PERIOD} * floor(x / {PERIOD}) - {PERIOD} / 2) < {DURATION} / 2 THEN 0.01 ELSE 0.0 END + 1e-3 * (value - 49) / 49 AS y FROM p1)
"""

DAILY_SQL = """
d0 AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(l_extendedprice) AS DOUBLE) AS s FROM lineitem GROUP BY 1),
lc AS (SELECT 'daily' AS lc_id, row_number() OVER (ORDER BY day) - 1 AS idx, CAST(day - (SELECT min(day) FROM d0) + 1 AS DOUBLE) AS t, s / (SELECT median(s) FROM d0) AS y FROM d0)
"""

STARS_SQL = """
stars AS (SELECT CAST(s_suppkey AS BIGINT) AS star_id, CAST(2500 + s_suppkey * 37 % 7000 AS DOUBLE) AS teff, 2.5 + CAST(s_suppkey * 13 % 25 AS DOUBLE) / 10 AS logg,
  0.1 + CAST(s_suppkey * 7 % 20 AS DOUBLE) / 10 AS mass, 0.2 + CAST(s_suppkey * 11 % 30 AS DOUBLE) / 10 AS radius FROM supplier)
"""
