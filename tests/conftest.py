import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """Readings of three stations on 60 slots with gaps, as tuples (station, slot, value)."""
    rows = []
    for s in range(3):
        for slot in range(60):
            if (slot * 7 + s * 3) % 11 == 0:
                continue
            rows.append((f"S{s:03d}", slot, ((slot * (s + 2)) % 13 - 8) / 10 if (slot * (s + 2)) % 13 > 8 else 0.0))
    return rows
