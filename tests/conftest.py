import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sparkoire.session import session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    out = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(df, sql, sf):
    """Whether a frame's rows are those of a statement, whatever their order."""
    cell = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    columns = sorted(df.columns)
    relation = duck(sf).sql(sql)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    expected = sorted([cell(r[i]) for i in at] for r in relation.fetchall())
    return sorted([cell(r[c]) for c in columns] for r in df.collect()), expected
