import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shelf(spark):
    """A corpus of 300 works by 12 authors with 8-dimensional vectors."""
    import numpy as np

    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(300, 8)).astype("float32")
    rows = [
        (
            f"Book|author {i % 12}|title {i}",
            i,
            f"author {i % 12}",
            f"title {i}",
            1900 + i % 90,
            i % 17,
            [float(x) for x in vecs[i]],
        )
        for i in range(300)
    ]
    corpus = spark.createDataFrame(
        rows,
        "input_text string, work_key long, author string, title string, year long, "
        "editions long, vec array<float>",
    ).repartition(4)
    unit = vecs.astype("float64")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    corpus.cache().count()
    return corpus, unit
