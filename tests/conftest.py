import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pricewren.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate one column expression over literal named inputs."""
    from pyspark.sql import functions as F

    def run(build, **inputs):
        df = spark.range(0, 1, 1, 1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
        return df.select(build(*[F.col(k) for k in inputs]).alias("v")).first()["v"]

    return run
