import math
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from ticklane.session import session, ship  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    made = session("local[4]", 4, **{"spark.driver.memory": "4g"})
    made.sparkContext.setLogLevel("ERROR")
    ship(made)
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A value that compares across engines."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return str(value) if hasattr(value, "tzinfo") else value


def table(columns, rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def same(duck, frame, sql: str) -> None:
    """The frame has the rows and columns of the SQL."""
    found = duck.execute(sql)
    names, rows = [x[0] for x in found.description], found.fetchall()
    assert sorted(frame.columns) == sorted(names)
    assert table(frame.columns, frame.collect()) == table(names, rows)
