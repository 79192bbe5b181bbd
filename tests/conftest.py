import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)


@pytest.fixture(scope="session")
def spark():
    from lectern.session import local_session, ship

    s = local_session(int(os.environ.get("TEST_CPUS", "8")), "tests")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    from lectern.session import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def same():
    """Whether two pandas frames hold the same rows, whatever their order."""

    def norm(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        try:
            return repr(round(float(v), 6))
        except (TypeError, ValueError):
            return str(v)

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)
        rows = [sorted(tuple(norm(v) for v in r) for r in x[cols].itertuples(index=False)) for x in (a, b)]
        assert rows[0] == rows[1]

    return check
