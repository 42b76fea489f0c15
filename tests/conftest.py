import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from preflight.session import get_spark  # noqa: E402

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
MANIFEST = os.path.join(FIXTURES, "wheels_manifest.json")
SF_SMALL = "/root/testdata/sf0.001"
P = "model.wheels."


@pytest.fixture(scope="session")
def spark():
    return get_spark("local[4]", shuffle_partitions=4)


@pytest.fixture(scope="session")
def catalog(spark):
    from preflight.sources.catalog import load_manifest
    return load_manifest(spark, MANIFEST)


@pytest.fixture(scope="session")
def wheel_tables(spark):
    """Small literal tables behind the manifest's relations."""
    stations = spark.createDataFrame([(1, "Ulm", "2019"), (2, None, "2020"), (3, "Ulm", None)],
                                     "station_id long, city string, opened_on string")
    rides = spark.createDataFrame(
        [(70, 1, "day", 10), (71, 1, "tour", 20), (72, 3, "dusk", 10), (72, 9, "day", 30),
         (73, None, None, 10), (73, 2, "dusk", None), (73, 2, "dawn", 20), (74, 8, "day", 20)],
        "ride_id long, station_id long, kind string, minutes int")
    load = spark.createDataFrame([(1, 2), (2, 2)], "station_id long, rides long")
    report = spark.createDataFrame([("Ulm", 3)], "city string, rides long")
    return {"lake.raw.stations": stations, "lake.core.rides": rides, "lake.core.station_load": load,
            "lake.reports.city_report": report}
