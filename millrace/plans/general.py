"""Queries of the general data-cleaning operators on the test tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.filling import fill_missing
from millrace.operators.gridding import regular
from millrace.operators.nearby import inside, placed, within
from millrace.operators.spikes import implausible
from millrace.plans.tables import table

BOUNDS = {"x2": (0.0, 1.0), "t8": (-70.0, 120.0)}


def p2_flagged(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "device_data"), BOUNDS, idle={"x2": 0.001})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_flagged(spark, d).select("reading_id", "field").distinct()


def p2_stuck(spark: SparkSession, d: str) -> DataFrame:
    """The impossible and stuck values among those flagged, without their score."""
    return p2_flagged(spark, d).where("reason <> 'spike'").select("reading_id", "field", "value", "reason")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """loc_a, loc_b, metres: devices at most 300 m apart, devices and weather points at most 7 km apart."""
    devices = placed(table(spark, d, "devices"), "deviceId", "latitude", "longitude")
    stations = placed(table(spark, d, "weather_cache"), "station_id", "latitude", "longitude")
    near = within(devices, devices, 300).where("id < centre").select(F.col("id").alias("loc_a"), F.col("centre").alias("loc_b"), "metres")
    covered = within(devices, stations, 7000).select(F.least("id", "centre").alias("loc_a"), F.greatest("id", "centre").alias("loc_b"), "metres")
    return near.unionByName(covered).withColumn("metres", F.round("metres", 3))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).select("loc_a", "loc_b").distinct()


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    """deviceId, station_id: devices in the region of a weather point, a rhombus of half a degree around it with a square hole of a tenth."""
    devices = placed(table(spark, d, "devices"), "deviceId", "latitude", "longitude")
    stations = placed(table(spark, d, "weather_cache"), "station_id", "latitude", "longitude")
    # A point that is written in several ways is several regions.
    region = F.concat_ws("|", "id", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("region")

    def ring(*corners: tuple[float, float]) -> Column:
        return F.array(*[F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat")) for x, y in corners])

    rings = F.array(ring((0.5, 0), (0, 0.5), (-0.5, 0), (0, -0.5)), ring((0.1, 0.1), (-0.1, 0.1), (-0.1, -0.1), (0.1, -0.1)))
    found = inside(devices, stations.select(region, F.explode(rings).alias("ring")))
    return found.select(F.col("id").alias("deviceId"), F.split_part("region", F.lit("|"), F.lit(1)).alias("station_id")).distinct()


def p4_filled(spark: SparkSession, d: str) -> DataFrame:
    filled = fill_missing(table(spark, d, "device_data"), {"x2": F.col("period") == "train", "t4": None}, categories=("deviceType",))
    return filled.withColumns({"value": F.round("value", 6), "distance_s": F.round("distance_s", 3)})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return fill_missing(table(spark, d, "device_data"), {"x2": F.col("period") == "train", "t4": None}).select("reading_id", "field")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular(table(spark, d, "device_data"), ["x2", "t4"]).withColumns({"x2": F.round("x2", 6), "t4": F.round("t4", 6)})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_grid(spark, d).where("n_readings = 0").select("deviceId", "slot_epoch")


QUERIES = {f.__name__: f for f in (p2_found, p2_flagged, p2_stuck, p3_found, p3_pairs, p3_regions, p4_found, p4_filled, p6_found, p6_grid)}
