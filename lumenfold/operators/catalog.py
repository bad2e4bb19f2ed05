"""Star catalogs and limb-darkening tables: both are tables that the caller supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Identifiers of the three catalogs; the second has a valid range.
CATALOGS = {"KIC_ID": None, "EPIC_ID": (201000001, 251813738), "TIC_ID": None}


def nearest_darkening(stars: DataFrame, table: DataFrame) -> DataFrame:
    """``stars`` (star_id, teff, logg, ..) with a, b of the table row (ld_row, teff, logg, a, b) nearest in temperature, then in gravity.

    Ties go to the row that comes first.  Each distinct temperature of the table is compared once with a star; the table itself is broadcast only where Spark finds it small.
    """
    t = table.select("ld_row", F.col("teff").cast("double").alias("__teff"), F.col("logg").cast("double").alias("__logg"), "a", "b")
    temps = t.groupBy("__teff").agg(F.min("ld_row").alias("__first")).agg(F.collect_list(F.struct("__teff", "__first")).alias("__temps"))
    rank = F.transform("__temps", lambda x: F.struct(F.abs(x["__teff"] - F.col("teff")).alias("d"), x["__first"].alias("r"), x["__teff"].alias("v")))
    near = stars.crossJoin(F.broadcast(temps)).withColumn("__at", F.array_min(rank)["v"]).drop("__temps")
    by = Window.partitionBy("star_id").orderBy(F.abs(F.col("__logg") - F.col("logg")), "ld_row")
    met = near.join(t, F.col("__at") == F.col("__teff")).withColumn("__k", F.row_number().over(by)).filter("__k = 1")
    return met.select(*stars.columns, "a", "b")


def catalog_info(catalog: DataFrame, table: DataFrame, **ident: int) -> DataFrame:
    """The star of exactly one of KIC_ID, EPIC_ID, TIC_ID: a, b, mass and radius with their limits.

    ``catalog``: star_id, teff, logg, mass, mass_min, mass_max, radius, radius_min, radius_max.  A mass or radius of 0 is unknown (NaN).
    """
    if len(ident) != 1 or next(iter(ident)) not in CATALOGS:
        raise ValueError(f"give exactly one of {', '.join(CATALOGS)}")
    (name, number), = ident.items()
    if isinstance(number, bool) or not isinstance(number, int):
        raise TypeError(f"{name} must be a whole number")
    if (limits := CATALOGS[name]) and not limits[0] <= number <= limits[1]:
        raise ValueError(f"{name} must be from {limits[0]} to {limits[1]}")
    known = lambda c: F.when(F.col(c) == 0, F.lit(float("nan"))).otherwise(F.col(c)).alias(c)
    star = nearest_darkening(catalog.filter(F.col("star_id") == number), table)
    return star.select("star_id", "a", "b", *[known(c) for c in ("mass", "mass_min", "mass_max", "radius", "radius_min", "radius_max")])
