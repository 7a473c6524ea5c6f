import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from beatframe.operators.layout import tune

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return tune(s)


@pytest.fixture(scope="session")
def signal(spark):
    """Two deterministic noisy signals of 180 and 131 samples with plateaus."""
    import math

    from beatframe.operators.layout import settle

    rows = []
    for seg, n in ((1, 180), (2, 131)):
        for i in range(n):
            x = math.sin(i * 0.37 * seg) + 0.6 * math.sin(i * 1.9) + 0.3 * math.cos(i * i * 0.05)
            rows.append((seg, i, round(x, 1) if seg == 2 else x, 20.0))
    return settle(spark.createDataFrame(rows, "segment_no int, idx int, x double, fs double"))
