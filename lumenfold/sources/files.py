"""CSV and INI sources, CSV and text sinks."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.params import SearchParams
from lumenfold.operators.lightcurve import from_columns


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", lc_id: str | None = None) -> DataFrame:
    """Light curves of headerless CSV with columns t, y and, if the file has a third, dy.  Several files: one curve each."""
    schema = "t double, y double, dy double"
    rows = spark.read.schema(schema).option("sep", delimiter).option("mode", "PERMISSIVE").csv(path)
    rows = rows.withColumn("__lc", F.lit(lc_id) if lc_id else F.input_file_name())
    return from_columns(rows, "t", "y", "dy", "__lc")


def read_false_alarms(spark: SparkSession, path: str) -> DataFrame:
    """row, fap, sde of a headerless CSV fap,sde in order of sde; ``None`` is no value, ``inf`` infinite."""
    raw = spark.read.schema("f string, s string").csv(path)
    num = lambda c: F.when(F.lower(F.col(c)) == "inf", F.lit(float("inf"))).otherwise(F.expr(f"try_cast({c} as double)"))
    rows = raw.select(num("f").alias("fap"), num("s").alias("sde"))
    packed = rows.agg(F.sort_array(F.collect_list(F.struct("sde", F.coalesce(-F.col("fap"), F.lit(float("-inf"))).alias("k"), "fap"))).alias("x"))
    return packed.select(F.posexplode("x").alias("row", "v")).select("row", "v.fap", "v.sde")


def read_darkening(spark: SparkSession, path: str) -> DataFrame:
    """ld_row, teff, logg, a, b of a CSV with a header that names logg, Teff, a and b."""
    rows = spark.read.option("header", True).csv(path).select(F.col("Teff").cast("double").alias("teff"), F.col("logg").cast("double").alias("logg"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    packed = rows.agg(F.sort_array(F.collect_list(F.struct("teff", "logg", "a", "b"))).alias("x"))
    return packed.select(F.posexplode("x").alias("ld_row", "v")).select("ld_row", "v.*")


_NAMES = {
    "Grid": {"R_star": float, "R_star_min": float, "R_star_max": float, "M_star": float, "M_star_min": float, "M_star_max": float, "period_min": float, "period_max": float, "n_transits_min": int},
    "Template": {"transit_template": str},
    "Speed": {"duration_grid_step": float, "transit_depth_min": float, "oversampling_factor": int, "T0_fit_margin": float, "use_threads": int},
}


def read_config(path: str) -> tuple[SearchParams, str]:
    """Parameters of an INI file with sections Grid, Template, Speed and File, and the file's delimiter; what is missing stays default."""
    ini = configparser.ConfigParser()
    ini.optionxform = str
    if not ini.read(path):
        raise FileNotFoundError(path)
    given = {}
    for section, names in _NAMES.items():
        if ini.has_section(section):
            lower = {k.lower(): v for k, v in ini.items(section)}
            given |= {name: kind(lower[name.lower()]) for name, kind in names.items() if name.lower() in lower}
    delimiter = ini.get("File", "delimiter", fallback=",").strip("\"' ") or ","
    return SearchParams.of(**given), delimiter


def write_power(spectrum: DataFrame, path: str) -> None:
    """period,power as CSV with six decimals, in order of period."""
    s = spectrum.orderBy("lc_id", "period").select(*[F.format_string("%.6f", F.col(c)).alias(c) for c in ("period", "power")])
    s.write.mode("overwrite").csv(path)


def statistics(result: DataFrame) -> DataFrame:
    """lc_id, key, value: the scalars of result rows, one a line."""
    names = [f.name for f in result.schema.fields if f.name != "lc_id" and f.dataType.simpleString() in ("double", "bigint", "int", "boolean", "string")]
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in names]))
    return result.select("lc_id", pairs.alias("x")).select("lc_id", "x.key", "x.value")


def write_statistics(result: DataFrame, path: str) -> None:
    """``key value`` lines."""
    statistics(result).select(F.concat_ws(" ", "key", F.coalesce("value", F.lit("nan")))).write.mode("overwrite").text(path)
