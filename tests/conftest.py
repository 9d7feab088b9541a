import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corpusloom.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "driver_memory": "4g"})


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with the rows of a SQL query, columns by name, doubles to six places."""

    def norm(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return tuple(map(norm, v)) if isinstance(v, list | tuple) else v

    def check(df, con, sql):
        rel = con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        cols = sorted(df.columns)
        mine = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
        names = ", ".join(f'"{c}"' for c in cols)
        theirs = sorted((tuple(map(norm, r)) for r in con.sql(f"select {names} from ({sql})").fetchall()), key=repr)
        assert mine == theirs

    return check
