"""Files, catalogs, command line, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold import cli
from lumenfold.operators import catalog
from lumenfold.plans import adapters
from lumenfold.sources import files
from lumenfold.streaming import flux


def test_csv_with_and_without_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2,1.0\n1,0.9\n")
    (tmp_path / "b.csv").write_text("1;1.0;0.1\n2;0.9;0.2\n")
    a = files.read_csv(spark, str(tmp_path / "a.csv"), lc_id="a").orderBy("idx").collect()
    assert [(r["t"], r["y"], r["dy"]) for r in a] == [(1.0, 0.9, None), (2.0, 1.0, None)]
    b = files.read_csv(spark, str(tmp_path / "b.csv"), ";", "b").collect()
    assert {r["dy"] for r in b} == {0.1, 0.2}


def test_config(tmp_path):
    (tmp_path / "c.cfg").write_text("[Grid]\nR_star = 0.8\nperiod_min = 2\n[Speed]\noversampling_factor = 5\n[File]\ndelimiter = ;\n")
    p, delimiter = files.read_config(str(tmp_path / "c.cfg"))
    assert (p.R_star, p.period_min, p.oversampling_factor, delimiter) == (0.8, 2.0, 5, ";")


def test_command_line(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    t = np.linspace(1, 21, 700)
    y = 1 + rng.normal(0, 3e-4, 700) - 0.01 * (np.abs((t - 2 + 1.5) % 3 - 1.5) < 0.08)
    (tmp_path / "lc.csv").write_text("".join(f"{a},{b}\n" for a, b in zip(t, y, strict=True)))
    (tmp_path / "c.cfg").write_text("[Grid]\nperiod_min = 2.5\nperiod_max = 4\n")
    cli.main([str(tmp_path / "lc.csv"), "-c", str(tmp_path / "c.cfg"), "-o", str(tmp_path / "out")])
    stats = dict(line["value"].split(" ", 1) for line in spark.read.text(str(tmp_path / "out_statistics.csv")).collect())
    assert float(stats["period"]) == pytest.approx(3, abs=0.03)
    power = spark.read.csv(str(tmp_path / "out_power.csv"))
    assert power.count() > 50 and len(power.first()[0].split(".")[1]) == 6


def test_catalog(spark):
    stars = spark.createDataFrame([(757076, 5160.0, 3.58, 1.2, 1.1, 1.3, 0.0, 3.0, 3.4)], "star_id long, teff double, logg double, mass double, mass_min double, mass_max double, radius double, radius_min double, radius_max double")
    table = adapters.darkening(spark)
    r = catalog.catalog_info(stars, table, KIC_ID=757076).first()
    assert r["a"] == pytest.approx(0.9 - 5050 / 20000) and r["b"] == pytest.approx(0.1 + 3.5 / 20) and np.isnan(r["radius"]) and r["mass"] == 1.2
    for wrong in ({}, {"KIC_ID": 1, "TIC_ID": 2}, {"EPIC_ID": 5}):
        with pytest.raises(ValueError):
            catalog.catalog_info(stars, table, **wrong)
    with pytest.raises(TypeError):
        catalog.catalog_info(stars, table, KIC_ID="757076")


def test_stream(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("lc_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") + 1).alias("y"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = flux.binned(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bins").agg(F.sum("n")).first()[0] == src.count()
    p = flux.prepared(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), 3.7, 0.2, 1.5).writeStream.format("memory").queryName("rows").option("checkpointLocation", str(tmp_path / "cp2")).start()
    p.processAllAvailable()
    p.stop()
    assert spark.table("rows").filter("phase between 0 and 1").count() == src.count()
