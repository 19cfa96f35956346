import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("DECKMILL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from deckmill.functions.ship import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Compares a query with its SQL, rows in any order."""
    import math

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return str(v)

    def check(query, sql):
        df = query(spark, data)
        cols = sorted(df.columns)
        got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
        cur = duck.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        exp = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
        assert got == exp

    return check
