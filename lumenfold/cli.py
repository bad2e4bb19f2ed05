"""python -m lumenfold.cli LIGHTCURVE [-c CONFIG] [-o OUT]: search a CSV light curve, write its spectrum and statistics."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lumenfold.functions.params import SearchParams
from lumenfold.operators.search import search
from lumenfold.sources.files import read_config, read_csv, write_power, write_statistics


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lumenfold", description="Find periodic dips in a light curve (CSV: time in days, flux, error).")
    parser.add_argument("lightcurve")
    parser.add_argument("-c", "--config", help="INI file with sections Grid, Template, Speed, File")
    parser.add_argument("-o", "--output", help="prefix of the files written; the light curve's path by default")
    given = parser.parse_args(args)
    params, delimiter = read_config(given.config) if given.config else (SearchParams().validated(), ",")
    spark = SparkSession.builder.appName("lumenfold").getOrCreate()
    result, spectrum = search(read_csv(spark, given.lightcurve, delimiter), params)
    out = given.output or given.lightcurve
    write_power(spectrum, f"{out}_power.csv")
    write_statistics(result, f"{out}_statistics.csv")


if __name__ == "__main__":
    main()
