"""Dates, angles, names and projections at known values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rillgrid.functions import axial, dates, geometry, names, numbers, projections
from rillgrid.operators import stats


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("days", "weight"), [(30, 0.4868), (16, 0.8148), (62, 0.0462), (76, 0.0098)])
def test_gauss(spark, days, weight):
    assert abs(one(spark, dates.gauss(F.col("d")), d=days) - weight) < 1e-4


@pytest.mark.parametrize(("mode", "days"), [("nominal", 10), ("first_of_month", 1)])
def test_days_around_the_year(spark, mode, days):
    assert one(spark, dates.delta_days(F.col("d"), 1, 10, mode, circular=True), d=dt.date(2025, 12, 31)) == days


def test_peaks_are_clamped_and_bad_dates_are_null(spark):
    assert one(spark, dates.peak_for_year(F.col("d"), 2, 30), d=dt.date(2024, 6, 1)) == dt.date(2024, 2, 29)
    assert one(spark, dates.peak_for_year(F.col("d"), 2, 30), d=dt.date(2025, 6, 1)) == dt.date(2025, 2, 28)
    assert one(spark, dates.try_date(F.col("d")), d="2025-13-01") is None
    assert one(spark, dates.try_date(F.col("d")), d="2025-06-15 10:00:00") == dt.date(2025, 6, 15)
    with pytest.raises(ValueError):
        dates.gauss(F.lit(1), 0)


def test_axial_means(spark):
    def mean(rows, **options):
        df = spark.createDataFrame(rows, "t double, w double")
        return df.agg(axial.axial_mean(F.col("t"), F.col("w"), **options).alias("x")).first()["x"]

    assert abs(mean([(10.0, 1.0), (170.0, 1.0)]) % 180) < 1e-9
    assert abs(mean([(80.0, 1.0), (100.0, 3.0)]) - 95.1) < 0.1
    assert mean([(0.0, 1.0), (90.0, 1.0)]) == -1.0  # they cancel
    assert mean([(30.0, 0.0)]) == -1.0 and mean([]) == -1.0
    assert abs(mean([(-1.0, 1.0)]) - 179.0) < 1e-9
    assert mean([(-1.0, 1.0)], negative="skip") == -1.0


def test_trimmed_mean(spark):
    rows = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 10.0)] + [("b", 3.0)], "k string, length_m double")
    assert {r["k"]: r["mean_branch_len_95_m"] for r in stats.p95_mean(rows, ["k"]).collect()} == {"a": 1.5, "b": 3.0}
    assert stats.p95_mean(rows, []).first()[0] == 2.0


def test_names(spark):
    assert one(spark, names.expected_package(F.col("p")), p="/a/Mosaic_1_2-MASK.tif") == "Mosaic_1_2_TCN.gpkg"
    assert one(spark, names.subtile_id(F.col("p")), p="x/Mosaic_1_2_tcn_summary.gpkg") == "Mosaic_1_2"
    assert one(spark, names.subtile_digits(F.col("p")), p="Mosaic_1_2_0045_mask.tif") == "0045"
    assert one(spark, names.subtile_digits(F.col("p")), p="Mosaic_ab.tif") == "ab"
    assert one(spark, names.srs_label(F.lit("epsg"), F.lit(3338), F.lit(7))) == "EPSG:3338"
    assert one(spark, names.json_crs(F.lit("not json"))) == "EPSG:4326"


def test_numbers(spark):
    assert [one(spark, numbers.round_half_even(F.col("x")), x=x) for x in (0.5, 1.5, 2.5, -0.5)] == [0, 2, 2, 0]
    assert [one(spark, numbers.round16(F.col("x")), x=x) for x in (3, 16, 47)] == [16, 16, 32]
    assert one(spark, numbers.step_length(F.lit(0.5), F.lit(-0.5))) == 0.5
    assert one(spark, numbers.step_length(F.lit(0.7), F.lit(-0.5))) == 0.5


def test_projections(spark):
    x, y = projections.reproject(F.col("lon"), F.col("lat"), 4326, 3338)
    r = spark.createDataFrame([(-154.0, 50.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).first()
    assert abs(r["x"]) < 1e-6 and abs(r["y"]) < 1e-6
    x, y = projections.reproject(F.col("lon"), F.col("lat"), 4326, 3413)
    r = spark.createDataFrame([(-45.0, 70.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).first()
    # On the true-scale parallel the radius is that of the parallel itself.
    f, phi = 1 / 298.257223563, math.radians(70)
    assert abs(r["x"]) < 1e-6 and abs(r["y"] + 6378137 * math.cos(phi) / math.sqrt(1 - f * (2 - f) * math.sin(phi) ** 2)) < 1e-3


def test_geometry():
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    for kind, parts in ((geometry.POINT, [1.0, 2.0]), (geometry.LINE, square), (geometry.POLYGON, [square]), (geometry.MULTI_POLYGON, [[square], [square]])):
        got_kind, got = geometry.decode(geometry.encode(kind, parts))
        assert got_kind == kind and str(got).replace(".0", "").replace("[", "(").replace("]", ")") == str(parts).replace(".0", "").replace("[", "(").replace("]", ")")
    clipped = geometry.clip_ring([(x, y) for x, y in square[:-1]], (1, 1, 9, 3))
    area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(clipped, clipped[1:], strict=False))) / 2
    assert area == 6 and geometry.clip_ring(square[:-1], (5, 5, 6, 6)) == []
    assert geometry.simplify([(0, 0), (1, 0.1), (2, 0), (3, 5)], 0.5) == [(0, 0), (2, 0), (3, 5)]
