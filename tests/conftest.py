import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tools"):
    sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    from ratewise.session import local_session

    session = local_session("tests", 8, "8g", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_ratings(spark):
    """The three ratings whose results are known by hand."""
    return spark.createDataFrame(
        [("u1", "i1", 5.0), ("u1", "i2", 3.0), ("u2", "i1", 4.0)], "user_id string, item_id string, rating double"
    )


@pytest.fixture(scope="session")
def random_ratings(spark):
    """A random sparse matrix with one user who rated everything, as (DataFrame, dense array)."""
    import numpy as np

    rng = np.random.default_rng(7)
    dense = np.where(rng.random((25, 18)) < 0.35, rng.integers(1, 6, (25, 18)), 0).astype(float)
    dense[3] = rng.integers(1, 6, 18)
    dense[:, 5] = rng.integers(1, 6, 25)
    rows = [(int(u), int(i), float(dense[u, i])) for u, i in zip(*np.nonzero(dense))]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double"), dense
