import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from junctura.session import session

    at = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g", spark__local__dir=str(at / "local"), spark__checkpoint__dir=str(at / "checkpoints"), spark__sql__warehouse__dir=str(at / "warehouse"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="session")
def same_as_sql(duck):
    """A check that a DataFrame has the rows and columns of a SQL text."""

    def check(df, sql):
        cols = sorted(df.columns)
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == cols
        rows = [tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()]
        got = [tuple(plain(x) for x in r) for r in df.select(*cols).collect()]
        assert sorted(got, key=repr) == sorted(rows, key=repr)

    return check
