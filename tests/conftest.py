import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def _free(request):
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        files = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return c


@pytest.fixture(scope="session")
def data():
    return DATA


def plain(df):
    """Rows of a pandas frame as sorted text, columns by name."""
    cols = sorted(df.columns)

    def say(v):
        return "null" if v is None or str(v) in ("NaT", "<NA>", "nan") else f"{v:.6f}" if isinstance(v, float) else str(v)

    def number(v):
        return float(v) if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and getattr(v, "ndim", 1) == 0 and not isinstance(v, bool) else v

    return sorted(tuple(say(number(v)) for v in row) for row in df[cols].itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    return lambda a, b: (sorted(a.columns) == sorted(b.columns)) and plain(a) == plain(b)
